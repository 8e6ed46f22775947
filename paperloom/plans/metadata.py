"""Queries on metadata records, classes, text functions and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import metadata as M
from ..operators import records as R
from .rendered import DOCUMENTS, RESPONSES, TITLES, view

DOCS = f"docs AS ({DOCUMENTS})"
MASKED = rf"masked AS (SELECT doc_id, path, regexp_replace(text, '\d{{6}}-\d{{7}}', '******-*******', 'g') AS text FROM docs)"
TYPED = r"""typed AS (SELECT *, CASE WHEN contains(substr(text, 1, 400), '동의서') OR contains(text, '개인정보 수집') OR contains(text, '동의 철회') THEN '동의서'
  WHEN contains(substr(text, 1, 400), '계약서') OR regexp_matches(text, '(?m)^제\d+조\(') THEN '계약서'
  WHEN contains(text, '갑') AND contains(text, '을') THEN '계약서' ELSE '동의서' END AS document_type FROM masked)"""
_D = r"'(20\d{2})[.\-/년]\s*(\d{1,2})[.\-/월]\s*(\d{1,2})'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _date(text: str, at: str) -> str:
    g = [f"regexp_extract_all({text}, {_D}, {i})[{at}]" for i in (1, 2, 3)]
    return f"{g[0]} || '-' || lpad({g[1]}, 2, '0') || '-' || lpad({g[2]}, 2, '0')"


def docs(spark, sf_dir):
    return view(spark, sf_dir, DOCUMENTS)


def contract_records(spark, sf_dir):
    rows = M.contract_records(docs(spark, sf_dir))
    one = lambda role: F.get(F.filter("parties", lambda p: p["role"] == role), 0)
    return rows.select(
        "doc_id", "document_type", "identifier", "checksum_sha256", "effective_date", "expiry_date", F.col("amount.value").alias("amount"),
        one("갑")["name"].alias("first_party"), one("갑")["registration_no"].alias("first_no"), one("을")["name"].alias("second_party"), "signature_presence",
    )


def _party(role: str) -> str:
    w = rf"regexp_extract(text, '{role}\s*[:：]([\s\S]{{0,180}})', 1)"
    return w, rf"CASE WHEN regexp_matches({w}, '\s*([가-힣A-Za-z().,\s-]{{2,60}})') THEN trim(regexp_extract({w}, '\s*([가-힣A-Za-z().,\s-]{{2,60}})', 1), {_WS}) END"


_W1, _P1 = _party("갑")
CONTRACT_SQL = rf"""WITH {DOCS}, {MASKED}, {TYPED}
SELECT doc_id, document_type, substr(sha256(text), 1, 16) AS identifier, sha256(text) AS checksum_sha256, {_date('text', '1')} AS effective_date, {_date('text', '-1')} AS expiry_date,
  TRY_CAST(regexp_replace(nullif(regexp_extract(text, '([₩]?\s*[\d,]+)\s*원', 1), ''), '[^\d]', '', 'g') AS BIGINT) AS amount,
  {_P1} AS first_party, CASE WHEN {_P1} IS NOT NULL THEN nullif(regexp_extract({_W1}, '(\d{{3}}-\d{{2}}-\d{{5}})', 1), '') END AS first_no, {_party('을')[1]} AS second_party,
  regexp_matches(text, '서명|날인') AS signature_presence
FROM typed WHERE document_type = '계약서' AND text IS NOT NULL"""


def consent_records(spark, sf_dir):
    rows = M.consent_records(docs(spark, sf_dir))
    return rows.select("doc_id", "multi_subject_index", "identifier", "subject.name", "subject.contact_phone", "subject.date_signed", "signature_presence")


_SUBJ = r"성명\s*[:：]\s*[가-힣A-Za-z\s]{2,20}"
CONSENT_SQL = rf"""WITH {DOCS}, {MASKED}, {TYPED}, c AS (SELECT doc_id, text, substr(sha256(text), 1, 16) AS identifier, regexp_matches(text, '서명|날인|서명란') AS signature_presence,
  CASE WHEN regexp_matches(text, '{_SUBJ}') THEN string_split(regexp_replace(text, '({_SUBJ})', '@@' || '\1', 'g'), '@@')[2:] ELSE [text] END AS blocks FROM typed WHERE document_type = '동의서' AND text IS NOT NULL),
b AS (SELECT doc_id, identifier, signature_presence, unnest(blocks) AS block, generate_subscripts(blocks, 1) - 1 AS multi_subject_index FROM c)
SELECT doc_id, CAST(multi_subject_index AS INT) AS multi_subject_index, identifier, trim(nullif(regexp_extract(block, '성명\s*[:：]\s*([가-힣A-Za-z\s]{{2,20}})', 1), ''), {_WS}) AS name,
  nullif(regexp_extract(block, '(\d{{2,3}}-\d{{3,4}}-\d{{4}})', 1), '') AS contact_phone, {_date('block', '-1')} AS date_signed, signature_presence FROM b"""


def extraction_manifest(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", "path")
    rows = M.contract_records(docs(spark, sf_dir)).select("doc_id", "document_type").unionByName(M.consent_records(docs(spark, sf_dir)).select("doc_id", "document_type"))
    return M.manifest(rows.join(own, "doc_id")).select("doc_id", "document_type", "outputs_count", "outputs")


MANIFEST_SQL = rf"""WITH {DOCS}, {MASKED}, {TYPED}, n AS (SELECT doc_id, path, document_type, CASE WHEN document_type = '계약서' THEN 1 ELSE greatest(1, len(regexp_extract_all(text, '{_SUBJ}'))) END AS n FROM typed WHERE text IS NOT NULL)
SELECT doc_id, document_type, CAST(n AS BIGINT) AS outputs_count, CASE WHEN n = 1 THEN replace(path, '.txt', '.json') ELSE array_to_string(list_transform(range(n), lambda i: replace(path, '.txt', '') || '__' || lpad(CAST(i AS STRING), 2, '0') || '.json'), ';') END AS outputs FROM n"""


def extract_parties(spark, sf_dir):
    return M.extract_parties(docs(spark, sf_dir))


PARTIES_SQL = rf"""WITH {DOCS} """ + " UNION ALL ".join(
    rf"""SELECT doc_id, '{r}' AS role, {_party(r)[1]} AS name, nullif(regexp_extract({_party(r)[0]}, '(\d{{3}}-\d{{2}}-\d{{5}})', 1), '') AS registration_no FROM docs WHERE {_party(r)[1]} IS NOT NULL""" for r in M.ROLES
)


def classify_documents(spark, sf_dir):
    path, text = F.col("path"), F.col("text")
    name = F.element_at(F.split(path, "/"), -1)
    return docs(spark, sf_dir).filter("text IS NOT NULL").select(
        "doc_id", C.detect_doc_type(text).alias("doc_type"), C.detect_document_type(name, text).alias("document_type"), C.document_type_from_title(F.substring_index(text, "\n", 1)).alias("title_type"),
        C.category_from_path(path).alias("path_category"), C.category_from_filename(name).alias("name_category"), C.category_from_anchor(path).alias("anchor"),
        C.schema_for_document_type(C.detect_document_type(name, text)).alias("schema"),
    )


# The words stand here once more, written by hand, so that a wrong table in the library does not pass.
_P2 = """CASE WHEN contains(lower(name), '계약서') OR contains(lower(name), 'contract') THEN '계약서'
  WHEN contains(lower(name), '동의서') OR contains(lower(name), 'consent') THEN '동의서'
  WHEN contains(lower(name), '양도') OR contains(lower(name), 'transfer') THEN '저작재산권 양도동의서'
  WHEN contains(lower(name), '공공') OR contains(lower(name), 'public') THEN '공공저작물 자유이용허락 동의서'
  WHEN contains(lower(content), '계약') OR contains(lower(content), 'contract') THEN '계약서'
  WHEN contains(lower(content), '동의') OR contains(lower(content), 'consent') THEN '동의서'
  WHEN contains(lower(content), '양도') OR contains(lower(content), 'transfer') THEN '저작재산권 양도동의서'
  WHEN contains(lower(content), '공공') OR contains(lower(content), 'public') THEN '공공저작물 자유이용허락 동의서'
  ELSE '기타문서' END"""
_P3 = """CASE WHEN contains(title, '양도동의서') OR contains(title, 'copyright transfer') OR contains(title, 'transfer consent') THEN '저작재산권 양도동의서'
  WHEN contains(title, '공공저작물 자유이용허락 동의서') OR contains(title, '공공누리') OR contains(title, 'public copyright') THEN '공공저작물 자유이용허락 동의서'
  WHEN contains(title, '계약서') OR contains(title, 'contract') OR contains(title, 'agreement') THEN '계약서'
  WHEN contains(title, '동의서') OR contains(title, 'consent') THEN '동의서' ELSE '기타문서' END"""
_P4 = """CASE WHEN contains(lower(path), '계약서') OR contains(lower(path), 'contract') THEN '계약서' WHEN contains(lower(path), '동의서') OR contains(lower(path), 'consent') THEN '동의서'
  WHEN contains(lower(stem), '계약') OR contains(lower(stem), 'contract') OR contains(lower(stem), 'agreement') THEN '계약서'
  WHEN contains(lower(stem), '동의') OR contains(lower(stem), 'consent') OR contains(lower(stem), 'approval') THEN '동의서' ELSE '동의서' END"""
_P5 = """CASE WHEN contains(lower(name), '계약서') OR contains(lower(name), 'contract') OR contains(lower(name), 'agreement') THEN 'contract'
  WHEN contains(lower(name), '동의서') OR contains(lower(name), 'consent') THEN 'consent'
  WHEN contains(lower(name), '저작권') OR contains(lower(name), 'copyright') OR contains(lower(name), '양도') THEN 'copyright' ELSE 'general' END"""


def _p7(kind: str) -> str:
    return f"""CASE WHEN contains(lower({kind}), '양도동의') OR contains(lower({kind}), 'copyright transfer') OR contains(lower({kind}), 'transfer consent') THEN 'copyright_transfer'
  WHEN contains(lower({kind}), '공공저작물') OR contains(lower({kind}), '공공누리') OR contains(lower({kind}), '자유이용허락') OR contains(lower({kind}), 'public copyright') THEN 'public_copyright'
  WHEN contains(lower({kind}), '계약서') OR contains(lower({kind}), 'contract') THEN 'contract_enhanced' WHEN contains(lower({kind}), '동의서') OR contains(lower({kind}), 'consent') THEN 'consent_enhanced' ELSE 'general_enhanced' END"""


CLASSIFY_SQL = rf"""WITH {DOCS}, masked AS (SELECT * FROM docs WHERE text IS NOT NULL), {TYPED}, n AS (SELECT *, text AS content, string_split(path, '/')[-1] AS name, replace(string_split(path, '/')[-1], '.txt', '') AS stem, string_split(text, chr(10))[1] AS title FROM typed), t AS (SELECT *, {_P2} AS p2 FROM n)
SELECT doc_id, document_type AS doc_type, p2 AS document_type, {_P3} AS title_type, {_P4} AS path_category, {_P5} AS name_category, nullif(regexp_extract(path, '/(?:data|documents|files|images)/([^/]+)', 1), '') AS anchor, {_p7('p2')} AS schema FROM t"""


def classify_titles(spark, sf_dir):
    """P2, P3, P5 and P7 on names, titles and types that reach every branch."""
    return view(spark, sf_dir, TITLES).select(
        "doc_id", C.detect_document_type(F.col("name"), F.col("content")).alias("document_type"), C.document_type_from_title(F.col("title")).alias("title_type"),
        C.category_from_filename(F.col("name")).alias("name_category"), C.schema_for_document_type(F.col("kind")).alias("schema"),
    )


TITLES_SQL = f"WITH t AS ({TITLES}) SELECT doc_id, {_P2} AS document_type, {_P3} AS title_type, {_P5} AS name_category, {_p7('kind')} AS schema FROM t"


def text_functions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.col("text")
    return d.select(
        "doc_id", F.md5(T.collapse_whitespace(t)).alias("collapsed"), T.identifier(T.mask_resident_id(t)).alias("identifier"), F.md5(T.clean_entity(t)).alias("cleaned"), T.extract_phone(t).alias("phone"),
        T.coerce_payment_amount(t).alias("number"), F.round(T.estimate_cost(t, F.lit(0.002)), 8).alias("cost"), T.safe_model_name(F.concat("lang", F.lit("/"), "source")).alias("model"), F.md5(T.strip_ws(t)).alias("stripped"),
    )


TEXT_SQL = rf"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, substr(sha256(regexp_replace(text, '\d{{6}}-\d{{7}}', '******-*******', 'g')), 1, 16) AS identifier,
  md5(regexp_replace(regexp_replace(trim(text, {_WS}), '^[:\s,.\-]+', ''), '[:\s,.\-]+$', '')) AS cleaned, nullif(regexp_extract(text, '(\d{{2,3}}-\d{{3,4}}-\d{{4}})', 1), '') AS phone,
  TRY_CAST(nullif(regexp_extract(text, '(\d+)', 1), '') AS BIGINT) AS number, round(length(text) / 4 * 0.002 / 1000, 8) AS cost, replace(lang || '/' || source, '/', '-') AS model, md5(trim(text, {_WS})) AS stripped FROM documents"""


def mark_sections(spark, sf_dir):
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", T.mark_sections(F.col("text"), "contract").alias("text"))


MARK_SQL = rf"""WITH {DOCS}, c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM docs WHERE text IS NOT NULL)
SELECT doc_id, regexp_replace(t, '(제[1-5]조)', chr(10) || '\1', 'g') AS text FROM c"""


def pack_sentences(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(T.pack_sentences(F.col("text"))).alias("part", "text"))


# A list of no sentences has one empty element, as DuckDB reduces no empty list; its result is not used.
PACK_SQL = rf"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(replace(text, chr(10), '. '), '.'), lambda s: trim(s, {_WS})), lambda s: s <> '') AS p FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, text, len(p) AS n, list_reduce(list_transform(CASE WHEN len(p) = 0 THEN [''] ELSE p END, lambda s: {{'done': CAST([] AS STRING[]), 'cur': s || '. '}}),
  lambda a, b: CASE WHEN length(a.cur) + length(b.cur) - 2 <= 512 THEN {{'done': a.done, 'cur': a.cur || b.cur}} ELSE {{'done': list_append(a.done, trim(a.cur, {_WS})), 'cur': b.cur}} END) AS s FROM p),
l AS (SELECT doc_id, CASE WHEN length(text) <= 512 THEN [text] WHEN n = 0 THEN [] ELSE list_append(s.done, trim(s.cur, {_WS})) END AS l FROM r)
SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS part, unnest(l) AS text FROM l"""


def model_answers(spark, sf_dir):
    r = F.col("response")
    return view(spark, sf_dir, RESPONSES).select("doc_id", T.json_slice(r).alias("slice"), T.parse_model_json(r).alias("metadata"), T.strip_markdown(r).alias("plain"))


ANSWERS_SQL = rf"""WITH r AS ({RESPONSES}), b AS (SELECT *, coalesce(nullif(regexp_extract(response, '```json\s*(.*?)```', 1, 's'), ''), response) AS own FROM r),
s AS (SELECT *, nullif(regexp_extract(own, '(\{{.*\}})', 1, 's'), '') AS slice FROM b)
SELECT doc_id, slice, CASE WHEN json_valid(slice) THEN slice ELSE '{{}}' END AS metadata, trim(regexp_replace(response, '```[a-zA-Z]*\n?', '', 'g'), {_WS}) AS plain FROM s"""


def consent_status(spark, sf_dir):
    line = F.get(F.filter(F.split("text", "\n"), lambda x: x.startswith("동의 여부:")), 0)
    rows = docs(spark, sf_dir).select("doc_id", line.alias("line"))
    return rows.select("doc_id", T.normalize_consent_status(F.col("line")).alias("consent_status"))


STATUS_SQL = rf"""WITH {DOCS} SELECT doc_id, CASE WHEN NOT contains(text, '동의 여부:') OR text IS NULL THEN NULL WHEN contains(text, '동의 여부: 동의함') THEN '동의함' ELSE '동의하지 않음' END AS consent_status FROM docs"""


def _answers(spark, sf_dir):
    k = F.col("o_orderkey")
    return view(spark, sf_dir, "SELECT * FROM orders").select(
        k.alias("doc_id"), F.when(k % 4 != 0, F.lit("매매")).alias("contract_type"), F.when(k % 5 != 0, F.lit("가온")).alias("rights_holder"), F.when(k % 7 != 0, F.lit("나래")).alias("user"),
        ((k % 13) / 10.0).alias("confidence"), F.when(k % 9 == 0, F.lit("timeout")).alias("error"),
    )


_ANS = """a AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 <> 0 AS c, o_orderkey % 5 <> 0 AS r, o_orderkey % 7 <> 0 AS u, CAST(o_orderkey % 13 AS DOUBLE) / 10 AS confidence, o_orderkey % 9 = 0 AS failed FROM orders)"""


def validate_records(spark, sf_dir):
    rows = R.validate_records(_answers(spark, sf_dir), "contract")
    return rows.select("doc_id", F.array_join("_validation_errors", "; ").alias("errors"), F.round(R.completeness(rows, "contract"), 6).alias("completeness"))


VALIDATE_SQL = rf"""WITH {_ANS} SELECT doc_id, concat_ws('; ', CASE WHEN NOT c THEN 'contract_type: is required' END, CASE WHEN NOT r THEN 'rights_holder: is required' END, CASE WHEN NOT u THEN 'user: is required' END,
  CASE WHEN confidence > 1 THEN 'confidence: is too large' END) AS errors, round((CAST(c AS INT) + CAST(r AS INT) + CAST(u AS INT)) / 18.0, 6) AS completeness FROM a"""


def extraction_summary(spark, sf_dir):
    return R.extraction_summary(_answers(spark, sf_dir))


SUMMARY_SQL = rf"""WITH {_ANS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT failed) AS success, count(*) FILTER (WHERE failed) AS failed, round(avg(confidence) FILTER (WHERE NOT failed), 6) AS mean_confidence FROM a"""


def route_extraction(spark, sf_dir):
    name = F.element_at(F.split("path", "/"), -1)
    rows = docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", C.detect_document_type(name, F.col("text")).alias("document_type"))
    return R.route_extraction(rows).select("doc_id", "document_type", "schema", "required")


ROUTE_SQL = rf"""WITH {DOCS}, n AS (SELECT *, text AS content, string_split(path, '/')[-1] AS name FROM docs WHERE text IS NOT NULL), t AS (SELECT doc_id, {_P2} AS document_type FROM n), s AS (SELECT *, {_p7('document_type')} AS schema FROM t)
SELECT doc_id, document_type, schema, CASE schema WHEN 'contract_enhanced' THEN 'contract_type,rights_holder,user,granted_rights' WHEN 'consent_enhanced' THEN 'consent_type,data_controller,consent_status' WHEN 'general_enhanced' THEN 'document_type,title'
  WHEN 'copyright_transfer' THEN 'document_type,work_info,copyright_transfer,consent_info,parties' ELSE 'consent_type,work_display,copyright_license,public_nuri_license' END AS required FROM s"""


def _transfers(spark, sf_dir):
    """Nested records made of orders, with gaps."""
    k = F.col("o_orderkey")
    some = lambda n, value: F.when(k % n != 0, F.lit(value))
    work = F.struct(some(3, "작품").alias("work_title"), F.when(k % 5 == 0, F.lit("조각")).otherwise(F.lit("도서")).alias("work_type"))
    party = lambda n: F.struct(some(n, "가온").alias("name"), F.when(k % 8 == 0, F.lit("친구")).when(k % 8 != 1, F.lit("저작자")).alias("role"))
    return view(spark, sf_dir, "SELECT * FROM orders").select(
        k.alias("doc_id"), some(7, "양도동의서").alias("document_type"), F.when(k % 11 != 0, work).alias("work_info"),
        F.struct(F.lit("전체양도").alias("transfer_type"), some(2, "전부").alias("transfer_scope")).alias("copyright_transfer"),
        F.struct(F.lit("조건부동의").alias("consent_status"), F.lit("2024-01-01").alias("consent_date")).alias("consent_info"), F.array(party(4), party(6)).alias("parties"),
        F.struct(((k % 15) / 10).alias("extraction_confidence")).alias("checkbox_info"),
    )


def validate_nested(spark, sf_dir):
    """J5 and T16 with the rules of the transfer consents: nested fields, list items, enumerations and bounds."""
    rows = R.validate_records(_transfers(spark, sf_dir), "copyright_transfer")
    return rows.select("doc_id", F.array_join("_validation_errors", "; ").alias("errors"), F.round(R.completeness(rows, "copyright_transfer"), 6).alias("completeness"))


NESTED_SQL = """WITH k AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS doc_id, concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'document_type: is required' END, CASE WHEN k % 11 = 0 THEN 'work_info: is required' END,
    CASE WHEN k % 11 <> 0 AND k % 3 = 0 THEN 'work_info.work_title: is required' END, CASE WHEN k % 11 <> 0 AND k % 5 = 0 THEN 'work_info.work_type: is not one of the allowed values' END,
    CASE WHEN k % 2 = 0 THEN 'copyright_transfer.transfer_scope: is required' END,
    CASE WHEN k % 4 = 0 THEN 'parties/0/name: is required' END, CASE WHEN k % 6 = 0 THEN 'parties/1/name: is required' END,
    CASE WHEN k % 8 = 1 THEN 'parties/0/role: is required' END, CASE WHEN k % 8 = 1 THEN 'parties/1/role: is required' END,
    CASE WHEN k % 8 = 0 THEN 'parties/0/role: is not one of the allowed values' END, CASE WHEN k % 8 = 0 THEN 'parties/1/role: is not one of the allowed values' END,
    CASE WHEN k % 15 > 10 THEN 'checkbox_info.extraction_confidence: is too large' END) AS errors,
  round((CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END + 4) / 10.0, 6) AS completeness FROM k"""

QUERIES = {
    "contract_records": contract_records, "consent_records": consent_records, "extraction_manifest": extraction_manifest, "extract_parties": extract_parties, "classify_documents": classify_documents,
    "text_functions": text_functions, "mark_sections": mark_sections, "pack_sentences": pack_sentences, "model_answers": model_answers, "consent_status": consent_status, "validate_records": validate_records,
    "extraction_summary": extraction_summary, "route_extraction": route_extraction, "classify_titles": classify_titles, "validate_nested": validate_nested,
}
SQL = {
    "contract_records": CONTRACT_SQL, "consent_records": CONSENT_SQL, "extraction_manifest": MANIFEST_SQL, "extract_parties": PARTIES_SQL, "classify_documents": CLASSIFY_SQL, "text_functions": TEXT_SQL,
    "mark_sections": MARK_SQL, "model_answers": ANSWERS_SQL, "consent_status": STATUS_SQL, "validate_records": VALIDATE_SQL, "extraction_summary": SUMMARY_SQL, "route_extraction": ROUTE_SQL,
    "classify_titles": TITLES_SQL, "validate_nested": NESTED_SQL, "pack_sentences": PACK_SQL,
}
