"""Line dedup over overlapping three-line windows.

Three consecutive lines are hashed to 128 bits; a window that occurs more than once anywhere keeps its first occurrence
(smallest identifier, then position).  The positions that later occurrences cover are merged into intervals, and the
lines outside them are joined again.  Only hashes and positions are shuffled for the search; each text moves once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, text_of

WINDOW = 3

_SPANS = """
  transform(sequence(0, size({p})), i -> struct(
    if(i = 0, 0, {p}[i - 1].stop) AS start,
    if(i = size({p}), {n}, {p}[i].start) AS stop))
"""


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sig, pos, w1, w2): one row per window that has something else than spaces in it."""
    lines = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("sig"), F.split(text_of(text_col), "\n").alias("lines")
    ).filter(F.size("lines") >= WINDOW)
    hashed = lines.select(
        "id", "sig", F.transform("lines", lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), (F.length(F.trim(x)) > 0).alias("t"))).alias("h")
    )
    found = hashed.select(
        "id",
        "sig",
        F.explode(
            F.expr(
                f"filter(transform(sequence(0, size(h) - {WINDOW}), i -> struct(i AS pos, xxhash64(h[i].a, h[i + 1].a, h[i + 2].a) AS w1, "
                "xxhash64(h[i].b, h[i + 1].b, h[i + 2].b) AS w2, h[i].t OR h[i + 1].t OR h[i + 2].t AS t)), x -> x.t)"
            )
        ).alias("w"),
    )
    return found.select("id", "sig", "w.pos", "w.w1", "w.w2")


def repeated_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig, starts): for each document the sorted starts of its windows that occurred before."""
    windows = _windows(docs, id_col, text_col)
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "sig", "pos")
    first = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = windows.join(first, ["w1", "w2"]).filter(place != F.col("first"))
    return later.groupBy("id", "sig").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with every later occurrence of a repeated three-line window taken out of its texts.

    Lines end at ``\\n``; they are compared as they are.  Texts of fewer than three lines have no window and stay; a null
    text stays null; windows of nothing but spaces (U+0020) never count.  Occurrences are ordered by identifier (null ones
    last), then by a hash of the text, then by position; overlapping repeats inside one text keep what no later
    occurrence covers.  Rows that repeat an identifier with the same text get the same result, rows that repeat it
    with another text are documents of their own.  A text may become empty; no row is dropped.  With ``counts`` two
    columns follow, ``n_lines`` and ``n_removed``.  Extra columns are kept.
    """
    sig, starts, spans, n_lines, n_removed = fresh(docs, "sig", "starts", "spans", "n_lines", "n_removed")
    found = repeated_positions(docs, id_col, text_col).select(F.col("id").alias("found_id"), F.col("sig").alias("found_sig"), F.col("starts").alias(starts))
    keyed = docs.withColumn(sig, F.xxhash64(text_of(text_col)))
    joined = keyed.join(found, keyed[id_col].eqNullSafe(F.col("found_id")) & (keyed[sig] == F.col("found_sig")), "left").drop("found_id", "found_sig")
    # starts -> merged covered intervals -> the spans between them
    merged = F.expr(
        f"transform(arrays_zip(filter(`{starts}`, (x, i) -> i = 0 OR x - `{starts}`[i - 1] > {WINDOW}), "
        f"filter(`{starts}`, (x, i) -> i = size(`{starts}`) - 1 OR `{starts}`[i + 1] - x > {WINDOW})), "
        f"z -> struct(z['0'] AS start, z['1'] + {WINDOW} AS stop))"
    )
    lines = F.split(F.col(text_col), "\n")
    out = joined.withColumn(spans, F.when(F.col(starts).isNotNull(), merged))
    removed = F.coalesce(F.aggregate(F.col(spans), F.lit(0), lambda a, x: a + x.stop - x.start), F.lit(0)).cast("long")
    if counts:
        out = out.withColumn(n_lines, F.size(F.split(text_of(text_col), "\n")).cast("long")).withColumn(n_removed, removed)
    left = F.expr(_SPANS.format(p=f"`{spans}`", n=f"size(split(`{text_col}`, '\n'))"))
    kept = F.array_join(F.flatten(F.transform(left, lambda s: F.slice(lines, s.start + 1, s.stop - s.start))), "\n")
    return out.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(kept)).drop(sig, starts, spans)


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs, counts=True)


OP2_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
), w AS (
  SELECT doc_id, pos, line, lead(line) OVER d AS l2, lead(line, 2) OVER d AS l3
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), o AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, pos) AS k
  FROM w WHERE l3 IS NOT NULL AND (trim(line) <> '' OR trim(l2) <> '' OR trim(l3) <> '')
), c AS (
  SELECT DISTINCT doc_id, pos + d AS pos FROM o, (VALUES (0), (1), (2)) v(d) WHERE k > 1
), k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS kept, count(*) AS n_lines,
         count(c.pos) AS n_removed
  FROM l LEFT JOIN c USING (doc_id, pos) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, coalesce(k.n_lines, 1) AS n_lines,
       coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)
"""
