"""Document fingerprints: a threshold-scaled sketch.

Every five-word shingle is hashed to 64 bits and kept when its hash lies below a fixed fraction of the hash range.  As
the threshold is the same for all documents, sketches of texts of very different lengths can be united, intersected
and compared without the texts.  The query's fingerprints hold the sketch of a quarter of the range, from which it estimates
containment; its likenesses are taken over all shingles, before they are thinned, so they are those of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, table, text_of

WORDS = 5
#: A shingle is retained with probability 1 / SCALE, where nothing else is asked for.
SCALE = 8
#: The scale that retains every shingle, and that of the query's fingerprints.
WHOLE, KEPT = 1, 4


def sketch(text: Column, k: int = WORDS, scale: int = SCALE) -> Column:
    """array<bigint>, sorted and distinct: the retained hashes of the k-word shingles of a text.

    Words are the runs between white space, in lower case.  Fewer than k words make one shingle, which is always retained;
    none make none.  Whether a shingle is retained depends on it alone, so a sketch holds the same hashes of what two texts
    share.  A text that has shingles of which none is retained has no sketch (null): nothing is known of it, while an empty
    sketch is that of a text without words.  With scale 1 every text has a sketch, and all estimates are exact.
    """
    return sketches(text, scale, k=k)[f"s{scale}"]


def sketches(text: Column, *scales: int, k: int = WORDS) -> Column:
    """struct<s1, s4, ...>: the sketches of a text at several scales, of shingles that are hashed once."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[\t\n\x0B\f\r]", " "), " "), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    finest = min(scales)

    def below(h: Column, scale: int) -> Column:
        return h if scale == WHOLE else F.filter(h, lambda x: x < F.lit(-(1 << 63) + (1 << 64) // scale))

    def thin(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, F.sort_array(F.array_distinct(below(many, finest)))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def known(t: Column) -> Column:
        return F.struct(*[F.when((F.size(t[f"s{c}"]) > 0) | (t["n"] == 0), t[f"s{c}"]).alias(f"s{c}") for c in scales])

    def coarser(t: Column) -> Column:
        return F.struct(t["n"].alias("n"), *[(t["s"] if c == finest else F.when(t["n"] >= k, below(t["s"], c)).otherwise(t["s"])).alias(f"s{c}") for c in scales])

    # each step is bound once: transform over a one-element array is SQL's let
    bound = F.transform(F.array(hashes), lambda h: F.struct(thin(h).alias("s"), F.size(h).alias("n")))
    return F.get(F.transform(F.transform(bound, coarser), known), 0)


def union(a: Column, b: Column) -> Column:
    """The sketch of the shingles of two texts taken together; null only if neither has a retained hash and one is null."""
    known = F.when(F.size(b) > 0, b)
    return F.coalesce(F.sort_array(F.array_union(a, b)), F.when(F.size(a) > 0, a), known)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; of two empty ones it is 1, and null where a sketch is null."""
    both, one = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(one == 0, F.lit(1.0)).otherwise(both / (one - both))).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too, however much longer b is; 1 when a is empty, null when a is null.

    A null b has shingles, but none of those that are retained of a.
    """
    both = F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(a.isNotNull(), F.greatest(both, F.lit(0)) / F.size(a)).cast("double")


def as_text(s: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash, in order."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprint(sketches: Column) -> Column:
    """A digest of all shingles, a colon and the sketch that is kept: equal sets of shingles give equal fingerprints.

    The digest tells texts apart of which no shingle is retained; all estimates are made of the sketch.
    """
    kept = F.coalesce(sketches[f"s{KEPT}"], F.array().cast("array<bigint>"))
    return F.concat(F.lower(F.lpad(F.hex(F.xxhash64(sketches[f"s{WHOLE}"])), 16, "0")), F.lit(":"), as_text(kept))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_shingles_kept, sketch): one row per input row; null texts are empty, extra columns are ignored.

    The sketch is null where a text has shingles of which none is retained.
    """
    s = docs.select(F.col(id_col).alias("doc_id"), sketch(text_of(text_col), k, scale).alias("sketch"))
    return s.select("doc_id", F.when(F.col("sketch").isNull(), 0).otherwise(F.size("sketch")).cast("long").alias("n_shingles_kept"), "sketch")


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, next_id): the next smaller identifier of the table, for the smallest the largest.

    Distinct identifiers, of any type that has an order, are sorted into ranges and written with the number of their range;
    the neighbour is found within the range, or at the top of the next one that has rows.  Only identifiers move, and
    what crosses ranges is one row per partition.
    """
    ids = docs.select(F.col(id_col).alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    dealt = durable(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    tops = dealt.groupBy("part").agg(F.max("doc_id").alias("top"))
    tops = tops.select("part", F.coalesce(F.lag("top").over(W.orderBy("part")), F.max("top").over(W.partitionBy())).alias("below"))
    near = dealt.withColumn("lower", F.lag("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
    return near.join(F.broadcast(tops), "part").select("doc_id", F.coalesce("lower", "below").alias("next_id"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document, by descending identifier, after the last the first.  Null texts are empty.  Rows without an identifier
    have no next document: it is taken as empty.  Of rows that repeat an identifier the smallest text is the next document of
    others.  ``fingerprint`` is a digest and the sketch that retains a quarter of the shingles.  ``near_edited`` and
    ``near_next`` are the likeness before thinning, the Jaccard similarity of all shingles; of two texts without words it is
    1.  ``kept_in_next`` and ``next_in_kept`` are estimated by the sketches: which share of the text's shingles the next
    document has, and which of the next document's the text; null where no shingle was retained of the one that is held.
    """
    same = id_col == "doc_id"
    docs = base = docs.select(F.col(id_col) if same else F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    # both joins read the same columns of the same rows, so that Spark moves the texts once and reuses the exchange; sketches
    # come after the joins, as plans with lambdas never count as the same, and as a text is smaller than its shingles
    own = base.filter("doc_id IS NOT NULL")
    want = next_ids(docs).select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"))
    heads = own.join(want, "doc_id").groupBy("for_id").agg(F.min("text").alias("next_text"))
    alone = base.filter("doc_id IS NULL").withColumn("next_text", F.lit(None).cast("string"))
    both = own.join(heads, own["doc_id"] == heads["for_id"]).drop("for_id").unionByName(alone).withColumn("next_text", text_of("next_text"))
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("own", sketches(F.col("text"), WHOLE, KEPT))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.substring(F.col("next_text"), F.lit(1), cut)))
    both = both.withColumn("other", sketches(F.col("edited"), WHOLE, KEPT)).withColumn("next", sketches(F.col("next_text"), WHOLE, KEPT))
    whole, kept = f"s{WHOLE}", f"s{KEPT}"
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own")[whole], F.col("other")[whole]).alias("near_edited"),
        likeness(F.col("own")[whole], F.col("next")[whole]).alias("near_next"),
        containment(F.col("own")[kept], F.col("next")[kept]).alias("kept_in_next"),
        containment(F.col("next")[kept], F.col("own")[kept]).alias("next_in_kept"),
    )


def op9_fingerprints(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
