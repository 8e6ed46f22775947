"""Exact dedup by content sort.

Rows are range-partitioned on the head of the normalised text, then on a hash of all of it (Spark samples the splitters,
which stay short however long the texts are).  Each partition is sorted externally, so equal texts lie next to each other
and the window below compares neighbours in full.  A text that holds so many rows that one range would be too large is
dealt into sub-ranges by a salt, as many as its rows ask for; its sub-groups are merged by a second content sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, durable, text_of

#: A text is salted from so many rows on, and a salt gets about as many.  In tables of more than HOT_LEAST * HOT_MOST rows it is
#: rows / HOT_MOST, so that at most HOT_MOST texts are hot; their hashes, 16 bytes each, are broadcast.
HOT_LEAST, HOT_MOST = 1000, 1 << 16
#: Characters of the text that splitters hold.
HEAD = 64


def hot_texts(hashes: DataFrame, rows: int) -> DataFrame:
    """(hash, salts): hashes of hot texts, HOT_MOST at most, and how many salts each is dealt to."""
    least = max(HOT_LEAST, -(-rows // HOT_MOST))
    return hashes.groupBy("hash").count().filter(F.col("count") > least).select("hash", F.ceil(F.col("count") / least).alias("salts"))


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, *carried: Column) -> tuple[DataFrame, list[Column], bool]:
    """Rows by content: (doc_id, norm, ..., place, first_id, size), place 1 first of its text and salt; the order of rows with
    equal texts; and whether any text is salted (``salts`` is not null).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest: {keep}")
    order = [F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()]
    base = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(text_col)).alias("norm"), *carried).withColumn("hash", F.xxhash64("norm"))
    base = base.withColumn("head", F.substring("norm", 1, HEAD))
    hot = durable(hot_texts(base.select("hash"), docs.count()))
    salted, key = not hot.isEmpty(), ["head", "hash"]
    if salted:
        base = base.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)))
        key = ["head", "hash", "salt"]
    group = W.partitionBy(*key, "norm")
    rows = (
        base.repartitionByRange(*key)
        .withColumn("place", F.row_number().over(group.orderBy(*order)))
        .withColumn("first_id", F.first("doc_id").over(group.orderBy(*order)))
        .withColumn("size", F.count(F.lit(1)).over(group))
    )
    return rows, order, salted


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one, and empty texts are equal to each
    other.  ``keep`` names the identifier that stays, "smallest" or "largest"; null identifiers lose to all others.  Of
    rows that repeat the kept identifier with an equal text, one has ``kept``.  Extra columns are ignored; an empty
    table gives an empty result.  Rows of a hot text that repeat one identifier share a salt.
    """
    rows, order, salted = _sorted(docs, id_col, text_col, keep)
    rows = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    keep_id, size = F.col("first_id"), F.col("size")
    if salted:
        # one row for each salt of a hot text, compared in full once more; a row for each hot text comes back, HOT_MOST at most
        whole = W.partitionBy("norm")
        merged = (
            rows.filter("place = 1 AND salts IS NOT NULL")
            .repartitionByRange("head", "hash")
            .withColumn("hot_keep", F.first("first_id").over(whole.orderBy(*order)))
            .withColumn("hot_size", F.sum("size").over(whole))
            .select("text_sha256", "hot_keep", "hot_size")
            .distinct()
        )
        rows = rows.join(F.broadcast(merged), "text_sha256", "left")
        keep_id, size = F.when(F.col("salts").isNotNull(), F.col("hot_keep")).otherwise(keep_id), F.coalesce("hot_size", "size")
    kept = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep_id)
    return rows.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of ``docs`` for each text, as it is: that with the kept identifier (see ``exact_duplicates``).

    Rows are told apart as rows, so identifiers may be null or repeat with other texts; every text stays once.
    """
    rows, order, salted = _sorted(docs, id_col, text_col, keep, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = rows.filter("place = 1")
    if not salted:
        return first.select("row.*")
    once = first.filter("salts IS NOT NULL").repartitionByRange("head", "hash").withColumn("k", F.row_number().over(W.partitionBy("norm").orderBy(*order))).filter("k = 1")
    return first.filter("salts IS NULL").select("row.*").unionByName(once.select("row.*"))


def op8_exact_dedup(spark, sf_dir):
    from .common import table

    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""
