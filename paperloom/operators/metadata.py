"""Rule metadata: parties, consent subjects, and the contract and consent records built of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.classify import CONSENT, CONTRACT, detect_doc_type
from ..sources.record_files import spread_files, write_files

# The roles of a contract and the shapes of names.
ROLES = ["갑", "을"]
PARTY_NAME = r"\s*([가-힣A-Za-z().,\s-]{2,60})"
SUBJECT = r"성명\s*[:：]\s*([가-힣A-Za-z\s]{2,20})"
WINDOW = 180
_MARK = "\x01"


def party(text: Column, role: str) -> Column:
    """struct(role, name, registration_no) of the first place of the role whose next characters hold a name, or null.

    A name may run over a line end, and one of white space only still counts, with an empty name.
    """
    windows = F.regexp_extract_all(text, F.lit(rf"{role}\s*[:：](?=([\s\S]{{0,{WINDOW}}}))"), F.lit(1))
    own = lambda w: F.struct(F.lit(role).alias("role"), T.strip_ws(F.regexp_extract(w, PARTY_NAME, 1)).alias("name"), T.extract_business_no(w).alias("registration_no"))
    return F.get(F.transform(F.slice(F.filter(windows, lambda w: w.rlike(PARTY_NAME)), 1, 1), own), 0)


def parties(text: Column) -> Column:
    """E5: at most one party for each role."""
    return F.filter(F.array(*[party(text, r) for r in ROLES]), lambda p: p.isNotNull())


def extract_parties(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """E5 in long form: (doc_id, role, name, registration_no)."""
    return df.select(F.col(id_col).alias("doc_id"), F.explode(parties(F.col(text_col))).alias("p")).select("doc_id", "p.*")


def subjects(text: Column) -> Column:
    """Array of struct(name, contact_phone, date_signed), one for each name block, or one for a text without blocks."""
    marked = F.regexp_replace(text, f"({SUBJECT})", _MARK + "$1")
    blocks = F.filter(F.split(marked, _MARK), lambda b: b.rlike("^" + SUBJECT))
    blocks = F.when(F.size(blocks) > 0, blocks).otherwise(F.array(text))

    def one(block: Column) -> Column:
        return F.struct(
            T.strip_ws(T.first_group(block, SUBJECT)).alias("name"),
            T.extract_phone(block).alias("contact_phone"),
            T.extract_date_range(block)["expiry_date"].alias("date_signed"),
        )

    return F.transform(blocks, one)


def extract_consent_subjects(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """E6 with W4: (doc_id, subject_index from 0, name, contact_phone, date_signed)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(subjects(F.col(text_col))).alias("subject_index", "s"))
    return rows.select("doc_id", "subject_index", "s.*")


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forced: str | None = None) -> DataFrame:
    """(doc_id, text, document_type) with the text masked.

    The type does not depend on what is masked, so it is found on the text as it is; the one-element array keeps the optimizer
    from repeating a computed text for each of its conditions when the filter on the type moves down.
    """
    kind = F.get(F.transform(F.array(F.col(text_col)), lambda t: detect_doc_type(t, forced)), 0)
    path = ["path"] if "path" in df.columns else []
    return df.select(F.col(id_col).alias("doc_id"), *path, T.mask_resident_id(F.col(text_col)).alias("text"), kind.alias("document_type"))


def _common(df: DataFrame, id_col: str) -> list[Column]:
    """Page count (unknown in plain texts) and where a record comes from; the file name is that of ``path``, or of the identifier."""
    name = F.element_at(F.split(F.col("path" if "path" in df.columns else "doc_id").cast("string"), "/"), -1)
    source = F.struct(
        F.lit("기타").alias("source_platform"), name.alias("original_filename"), F.current_timestamp().alias("ingested_at"), F.lit("UNKNOWN").alias("ocr_engine"), F.lit("txt-v0.1").alias("pipeline_version")
    )
    return [F.lit(None).cast("int").alias("pages"), source.alias("provenance")]


def contract_records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forced: str | None = None) -> DataFrame:
    """One record for each contract; what is not found is null, parties an empty array.  Null texts give no record."""
    rows = classified(df, id_col, text_col, forced).filter(F.col("document_type") == CONTRACT)
    found = F.struct(T.extract_date_range(F.col("text")).alias("dates"), parties(F.col("text")).alias("parties"), T.extract_amount(F.col("text")).alias("found_amount"))
    rows = rows.select("*", F.inline(F.array(found)))  # once for each text, wherever it is used
    dates, amount = F.col("dates"), F.col("found_amount")
    return rows.select(
        "doc_id",
        "document_type",
        F.lit("계약서").alias("title"),
        T.identifier(F.col("text")).alias("identifier"),
        F.lit("ko").alias("language"),
        T.checksum(F.col("text")).alias("checksum_sha256"),
        dates["effective_date"].alias("effective_date"),
        dates["expiry_date"].alias("expiry_date"),
        F.when(amount.isNotNull(), F.struct(amount.alias("value"), F.lit("KRW").alias("currency"))).alias("amount"),
        "parties",
        T.has_signature(F.col("text")).alias("signature_presence"),
        *_common(rows, id_col),
    )


def consent_records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forced: str | None = None) -> DataFrame:
    """One record for each subject of a consent.  Null texts give no record."""
    rows = classified(df, id_col, text_col, forced).filter((F.col("document_type") == CONSENT) & F.col("text").isNotNull())
    rows = rows.select("*", *_common(rows, id_col))
    return rows.select("doc_id", "document_type", "text", "pages", "provenance", F.posexplode(subjects(F.col("text"))).alias("multi_subject_index", "subject")).select(
        "doc_id",
        "document_type",
        F.lit("개인정보 수집·이용 동의서").alias("title"),
        T.identifier(F.col("text")).alias("identifier"),
        F.lit("ko").alias("language"),
        T.checksum(F.col("text")).alias("checksum_sha256"),
        "subject",
        T.has_signature(F.col("text"), "consent").alias("signature_presence"),
        "multi_subject_index",
        "pages",
        "provenance",
    )


def manifest(records: DataFrame, path_col: str = "path", id_col: str = "doc_id", type_col: str = "document_type") -> DataFrame:
    """For each document its type, number of records and their file names, with a suffix where there are several."""
    counted = records.groupBy(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(type_col).alias("document_type")).agg(F.count(F.lit(1)).alias("outputs_count"))
    base = F.regexp_replace(F.col("path"), r"\.[^./]*\z", "")
    many = F.transform(F.sequence(F.lit(0), F.col("outputs_count").cast("int") - 1), lambda i: F.concat(base, F.lit("__"), F.lpad(i.cast("string"), 2, "0"), F.lit(".json")))
    return counted.withColumn("outputs", F.when(F.col("outputs_count") == 1, F.concat(base, F.lit(".json"))).otherwise(F.array_join(many, ";")))


def record_name(path: Column, index: Column, several: Column) -> Column:
    """The name of a record's file: the stem of its text, with `__NN` where the text has several records."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?\z", 1)
    return F.when(several, F.concat(stem, F.lit("__"), F.lpad(index.cast("string"), 2, "0"))).otherwise(stem)


def record_files(records: DataFrame, root: str = "", path_col: str = "path", index_col: str | None = "multi_subject_index") -> DataFrame:
    """(name, content): each record as JSON under the path of its text below ``root``, ``stem.json`` or ``stem__NN.json``.

    A text with several records has the suffix.  ``path`` and columns whose names begin with ``_`` other than
    ``_validation_errors`` are not part of the record, and null fields are left out.
    """
    path = F.regexp_replace(F.col(path_col), "^(?:file:/*(?=/))?" + re.escape(root.rstrip("/")) + "/*", "") if root else F.col(path_col)
    index = F.lit(0) if index_col is None or index_col not in records.columns else F.coalesce(index_col, F.lit(0))
    rows = records.withColumn("_index", index).withColumn("_several", F.count(F.lit(1)).over(W.partitionBy(path_col)) > 1)
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*\z", 1)
    own = [c for c in records.columns if c != path_col and (not c.startswith("_") or c == "_validation_errors")]
    return spread_files(rows.select(F.concat(folder, record_name(path, F.col("_index"), F.col("_several")), F.lit(".json")).alias("name"), F.to_json(F.struct(*own)).alias("content")))


def write_records(records: DataFrame, out: str, root: str = "", path_col: str = "path", job: str | None = None) -> None:
    """One JSON file for each record (see ``record_files``), all of them or none."""
    write_files(record_files(records, root, path_col), out, job)
