"""OCR responses: word boxes, lines, confidences, choice among engines, and documents put together from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIELDS = "struct<images:array<struct<fields:array<struct<inferText:string,inferConfidence:double,boundingPoly:struct<vertices:array<struct<x:double,y:double>>>>>>>>"
SYMBOLS = "struct<fullTextAnnotation:struct<pages:array<struct<blocks:array<struct<paragraphs:array<struct<words:array<struct<symbols:array<struct<text:string,confidence:double>>>>>>>>>>>>"
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
LINE_DISTANCE = 20
#: Distances up to which texts are compared before the whole product of their lengths is.
BANDS = (32, 256, 2048)


def parse_ocr_fields(df: DataFrame, id_col: str = "doc_id", json_col: str = "response") -> DataFrame:
    """(doc_id, image, y, x, text, confidence): one row per word; its place is the first vertex, a missing coordinate 0.

    Words without text or vertices have null places and count for confidence only; broken JSON gives no rows.
    """
    images = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.from_json(json_col, FIELDS)["images"]).alias("image", "i"))
    words = images.select("doc_id", "image", F.explode("i.fields").alias("f"))
    at = F.get(F.col("f.boundingPoly.vertices"), 0)
    place = lambda c: F.when(at.isNotNull() & (F.coalesce("f.inferText", F.lit("")) != ""), F.coalesce(at[c], F.lit(0.0)))
    return words.select("doc_id", "image", place("y").alias("y"), place("x").alias("x"), F.col("f.inferText").alias("text"), F.col("f.inferConfidence").alias("confidence"))


def parse_ocr_symbols(df: DataFrame, id_col: str = "doc_id", json_col: str = "response") -> DataFrame:
    """(doc_id, text, confidence): one row per symbol of the five-level tree."""
    pages = F.from_json(json_col, SYMBOLS)["fullTextAnnotation"]["pages"]
    blocks = F.flatten(F.transform(pages, lambda p: p["blocks"]))
    paragraphs = F.flatten(F.transform(blocks, lambda b: b["paragraphs"]))
    words = F.flatten(F.transform(paragraphs, lambda p: p["words"]))
    return df.select(F.col(id_col).alias("doc_id"), F.explode(F.flatten(F.transform(words, lambda w: w["symbols"]))).alias("s")).select("doc_id", "s.text", "s.confidence")


def _fold_lines(words: Column, threshold: int) -> Column:
    """Sorted (y, x, text) words as lines: a word joins while it is near the first word of the line."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("double").alias("anchor"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        joins = acc["anchor"].isNotNull() & (F.abs(w["y"] - acc["anchor"]) <= threshold)
        return F.when(joins, F.struct(acc["done"].alias("done"), acc["anchor"].alias("anchor"), F.concat(acc["line"], F.lit(" "), w["text"]).alias("line"))).otherwise(
            F.struct(F.when(acc["anchor"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["line"])).alias("done"), w["y"].cast("double").alias("anchor"), w["text"].alias("line"))
        )

    return F.aggregate(words, start, add, lambda acc: F.when(acc["anchor"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["line"])))


def group_ocr_lines(words: DataFrame, key: tuple[str, ...] = ("doc_id",), threshold: int = LINE_DISTANCE) -> DataFrame:
    """(key, text): the words of each page by (y, x) as lines; a group is one page."""
    some = words.filter(F.col("y").isNotNull() & F.col("text").isNotNull())
    pages = some.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "text"))).alias("w"))
    return pages.select(*key, F.array_join(_fold_lines(F.col("w"), threshold), "\n").alias("text"))


def ocr_confidence(items: DataFrame, key: tuple[str, ...] = ("doc_id",), col: str = "confidence") -> DataFrame:
    """Mean confidence, a missing one as 0."""
    return items.groupBy(*key).agg(F.avg(F.coalesce(F.col(col), F.lit(0.0))).alias("confidence"))


def edit_distance(a: Column, b: Column) -> Column:
    """The edit distance, exactly: bands widen until it fits, which costs less than the whole product where texts are near."""
    return F.coalesce(*[F.nullif(F.levenshtein(a, b, most), F.lit(-1)) for most in BANDS], F.levenshtein(a, b))


def choose_ocr_engine(pages: DataFrame, method: str = "google_priority", first: str = "google") -> DataFrame:
    """One result per (doc_id, page_number) out of (provider, extracted_text, status).

    google_priority: the first engine's result if it succeeded, else another that did; longest: the longest text;
    consensus: the text nearest to all others by edit distance.  Ties go to the smaller provider name.
    """
    ok = (F.col("status") == "success").cast("int")
    page = W.partitionBy("doc_id", "page_number")
    if method == "google_priority":
        order = [ok.desc(), (F.col("provider") == first).cast("int").desc()]
    elif method == "longest":
        order = [ok.desc(), F.length("extracted_text").desc()]
    elif method == "consensus":
        # of two results each is as near to the other, so only pages of three or more are compared, each pair once
        some = pages.withColumn("n", F.count(F.lit(1)).over(page)).filter("n > 2")
        other = some.select("doc_id", "page_number", F.col("provider").alias("p2"), F.col("extracted_text").alias("t2"))
        pairs = some.join(other, ["doc_id", "page_number"]).filter("provider < p2")
        longest = F.greatest(F.length("extracted_text"), F.length("t2"), F.lit(1))
        pairs = pairs.withColumn("s", 1 - edit_distance(F.col("extracted_text"), F.col("t2")) / longest)
        sides = pairs.select("doc_id", "page_number", F.explode(F.array("provider", "p2")).alias("provider"), "s")
        near = sides.groupBy("doc_id", "page_number", "provider").agg(F.avg("s").alias("near"))
        # by page alone, as everything else here, so that rows which lie together by page are not sent again
        near = near.groupBy("doc_id", "page_number").agg(F.map_from_entries(F.collect_list(F.struct("provider", "near"))).alias("near"))
        pages = pages.join(near, ["doc_id", "page_number"], "left")
        order = [ok.desc(), F.coalesce(F.try_element_at("near", F.col("provider")), F.lit(0.0)).desc()]
    else:
        raise ValueError(f"unknown method: {method}")
    best = pages.withColumn("place", F.row_number().over(page.orderBy(*order, "provider"))).filter("place = 1")
    return best.select("doc_id", "page_number", "provider", "extracted_text", "status")


def assemble_ocr_documents(pages: DataFrame, separator: str = PAGE_BREAK, skip_empty: bool = False) -> DataFrame:
    """(doc_id, full_text, total_pages, total_text_length): page texts in order; a failed page is an empty text."""
    text = F.when(F.col("status") == "success", F.coalesce("extracted_text", F.lit(""))).otherwise(F.lit(""))
    own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", text.alias("t")))).alias("p"), F.sum(F.length(text)).alias("total_text_length"))
    texts = F.filter(F.col("p.t"), lambda t: t != "") if skip_empty else F.col("p.t")
    return own.select("doc_id", F.array_join(texts, separator).alias("full_text"), F.size("p").alias("total_pages"), "total_text_length")


def number_pages(df: DataFrame, order: str) -> DataFrame:
    """page_number from 1 within each document, in the order given."""
    return df.withColumn("page_number", F.row_number().over(W.partitionBy("doc_id").orderBy(order)))


def ocr_batch_summary(files: DataFrame) -> DataFrame:
    """A5: files, processed, failed, pages and characters of each category, and of all (category null)."""
    ok = F.col("status") == "success"
    return files.rollup("category").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("processed"),
        F.count_if(~ok).alias("failed"),
        F.sum("total_pages").alias("pages"),
        F.sum("total_text_length").alias("characters"),
    )
