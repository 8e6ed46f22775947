"""Labelled sequences: span decoding, character labels, tagging, stratified splits and label statistics."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def decode_bio(tokens: DataFrame, key: tuple[str, ...] = ("sent_id",), label: str = "label", order: str = "pos", mode: str = "strict") -> DataFrame:
    """(key, type, start, end, confidence): spans of BIO token rows (pos, start, end, label, confidence).

    B begins a span and I of the same type goes on; anything else ends it.  An I without an open span of its type is
    nothing in mode "strict" and begins one in mode "lenient" (for scoring).  Rows with start = end = 0 are skipped.
    The confidence of a span is the least of its tokens.
    """
    rows = tokens.filter("NOT (start = 0 AND end = 0)").withColumn("head", F.substring(label, 1, 1)).withColumn("type", F.when(F.col(label) != "O", F.substring(label, 3, 200)))
    w = W.partitionBy(*key).orderBy(order)
    before = F.lag("type").over(w)
    loose = (F.col("head") == "I") & ~F.col("type").eqNullSafe(before)
    begins = (F.col("head") == "B") | (loose if mode == "lenient" else F.lit(False))
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("breaks", ((F.col("head") == "B") | (F.col("head") == "O") | loose).cast("int"))
    rows = rows.withColumn("span", F.sum("breaks").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = rows.filter("type IS NOT NULL").groupBy(*key, "span", "type").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("confidence").alias("confidence"), F.max("begins").alias("begins")
    )
    return spans.filter("begins = 1").select(*key, "type", "start", "end", "confidence")


def span_filter(spans: DataFrame, span_min: float = 0.75) -> DataFrame:
    """Spans whose least confidence lies above the bound."""
    return spans.filter(F.col("confidence") > span_min)


@F.arrow_udf(ArrayType(StringType()))
def tag_characters(text: pa.Array, entities: pa.Array) -> pa.Array:
    """Array of one BIO label per character; ``entities`` is array<struct<value,type>>.

    Longer entities come first, then the order given; every occurrence whose characters are all free is tagged, B on its
    first character that is no space and I on the others; spaces stay O.  One automaton of a text's values finds all places
    in one pass; a null text has null labels, null entities are none.
    """
    automata: dict[tuple, ahocorasick.Automaton | None] = {}

    def automaton(own: tuple) -> ahocorasick.Automaton | None:
        if own not in automata:
            if len(automata) >= 1000:
                automata.clear()
            found = ahocorasick.Automaton()
            for i, (value, kind) in enumerate(own):
                if value and value not in found:
                    found.add_word(value, (-len(value), i, len(value) - len(value.lstrip(" ")), kind))
            if len(found):
                found.make_automaton()
            automata[own] = found if len(found) else None
        return automata[own]

    def labels(value: str | None, own: list[dict] | None) -> list[str] | None:
        if value is None:
            return None
        out = ["O"] * len(value)
        found = automaton(tuple((e["value"], e["type"]) for e in own or () if e))
        if not found:
            return out
        taken = bytearray(len(value))
        for size, _, start, lead, kind in sorted((size, i, end + 1 + size, lead, kind) for end, (size, i, lead, kind) in found.iter(value)):
            if taken.find(1, start, start - size) < 0:
                taken[start : start - size] = b"\1" * -size
                out[start : start - size] = [f"I-{kind}" if c != " " else "O" for c in value[start : start - size]]
                if lead < -size:
                    out[start + lead] = f"B-{kind}"
        return out

    return pa.array([labels(t, e) for t, e in zip(text.to_pylist(), entities.to_pylist(), strict=True)], pa.list_(pa.string()))


def expand_token_labels(tokens: DataFrame, key: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """(key, char_pos, label): B on a token's first character and I after it; O as it is."""
    rows = tokens.filter(F.col("end") > F.col("start")).select(*key, "label", F.posexplode(F.sequence("start", F.col("end") - 1)).alias("k", "char_pos"))
    own = F.when((F.col("k") > 0) & F.col("label").startswith("B-"), F.concat(F.lit("I-"), F.substring("label", 3, 200))).otherwise(F.col("label"))
    return rows.select(*key, "char_pos", own.alias("label"))


def token_labels_of_chars(tokens: DataFrame, chars: DataFrame, key: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """E18 back: a token takes the label of its first character, O without one.

    A token comes once for each character that has its key and position; null ones match nothing.  Both become rows of one table,
    sorted by key and position: where both are spread by the key alone no row is sent, while a join on two columns sends them all.
    """
    kinds, values = tokens.schema, [c for c in tokens.columns if c not in (*key, "start", "label")]
    keys, null = [f"k{i}" for i in range(len(key))], F.lit(None)

    def rows(df: DataFrame, at: str, is_token: bool, char: Column, own: list[Column]) -> DataFrame:
        return df.select(*[F.col(c).alias(k) for c, k in zip(key, keys, strict=True)], F.col(at).alias("at"), char.alias("char"), F.lit(is_token).alias("is_token"), *[c.alias(f"v{i}") for i, c in enumerate(own)])

    # a character without a label still is one, so labels are in structs; characters that match nothing have none and are not filtered,
    # as both sides would then read other rows and could not share a shuffle
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*key, "char_pos")])
    own = rows(tokens, "start", True, null.cast("struct<label:string>"), [F.col(c) for c in values])
    both = own.unionAll(rows(chars, "char_pos", False, F.when(known, F.struct(F.col("label").cast("string").alias("label"))), [null.cast(kinds[c].dataType) for c in values]))
    found = both.withColumn("chars", F.collect_list("char").over(W.partitionBy(*keys, "at"))).filter("is_token").withColumn("char", F.explode_outer("chars"))
    out = [F.col(k).cast(kinds[c].dataType).alias(c) for c, k in zip((*key, "start"), (*keys, "at"), strict=True)]
    return found.select(*out, *[F.col(f"v{i}").alias(c) for i, c in enumerate(values)], F.coalesce("char.label", F.lit("O")).alias("label"))


def entity_types(labels: Column) -> Column:
    """The types that begin in a label array, each once."""
    return F.array_distinct(F.transform(F.filter(labels, lambda x: x.startswith("B-")), lambda x: F.substring(x, 3, 200)))


def stratified_split(sentences: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, id_col: str = "sent_id", labels_col: str = "labels") -> DataFrame:
    """W2 with J3: (sent_id, split): each type's sentences in hash order, cut at the ratios; sentences without a type are a stratum.

    A sentence may be in validation and test by different types; it is in train only if it is in neither.  The order is
    that of md5(seed/id), so it is the same however the data is partitioned.  Sentences are ranked within 4,096 ranges of the
    hash, after the counts of the ranges before, so a type of many sentences is not sorted in one task.
    """
    types = entity_types(F.col(labels_col))
    rows = sentences.select(F.col(id_col).alias("sent_id"), F.explode(F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("")))).alias("type"))
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("sent_id").cast("string")))
    rows = rows.withColumn("order", order).withColumn("part", F.substring("order", 1, 3))
    w, rank = W.partitionBy("type"), F.row_number().over(W.partitionBy("type", "part").orderBy("order", "sent_id"))
    parts = rows.groupBy("type", "part").agg(F.count(F.lit(1)).alias("own"))
    upto = F.sum("own").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    parts = parts.select("type", "part", (upto - F.col("own")).alias("before"), F.sum("own").over(w).alias("n"))
    rows = rows.join(parts, ["type", "part"]).withColumn("k", F.col("before") + rank)
    a = F.floor(F.col("n") * ratios[0])
    b = a + F.floor(F.col("n") * ratios[1])
    rows = rows.select("sent_id", F.when(F.col("k") <= a, "train").when(F.col("k") <= b, "validation").otherwise("test").alias("split")).distinct()
    held = rows.filter("split <> 'train'")
    return subtract_splits(rows.filter("split = 'train'"), held).unionByName(held)


def subtract_splits(train: DataFrame, *others: DataFrame) -> DataFrame:
    """Train without the sentences of the other splits."""
    for other in others:
        train = train.join(other.select("sent_id").distinct(), "sent_id", "left_anti")
    return train


def label_distribution(sentences: DataFrame, splits: DataFrame, id_col: str = "sent_id", labels_col: str = "labels") -> DataFrame:
    """(type, train, validation, test, total): sentences that contain each type, counted once each."""
    rows = sentences.select(F.col(id_col).alias("sent_id"), F.explode(entity_types(F.col(labels_col))).alias("type")).join(splits, "sent_id")
    wide = rows.groupBy("type").pivot("split", ["train", "validation", "test"]).count().fillna(0)
    return wide.withColumn("total", F.col("train") + F.col("validation") + F.col("test"))


def first_sentences(sentences: DataFrame, n: int, id_col: str = "sent_id") -> DataFrame:
    """K4."""
    return sentences.orderBy(id_col).limit(n)
