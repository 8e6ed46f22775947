"""Queries on injected models and services, prompts, records on their way through files, and spend by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fields as L
from ..operators import models as U
from ..operators import records as R
from ..sources import files as X
from ..operators.entities import extract_entities, write_entity_results
from ..sources.record_files import write_files
from ..streaming.metadata import metadata_stream
from .entities import FOUND
from .metadata import CONSENT_SQL, CONTRACT_SQL, DOCS, _answers, docs
from .rendered import ANSWERS, CALLS, DOCUMENTS, view

WIDTH, PAGE = 1000, 2000


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tagger():
    """Marks stretches of WIDTH characters, every other one as a name."""

    def tag(texts):
        return [[(k, min(k + WIDTH, len(t)), "O" if k // WIDTH % 2 else "B-NAME", 0.5 + k % 3 / 10) for k in range(0, len(t), WIDTH)] for t in texts]

    return tag


def model_tokens(spark, sf_dir):
    """U1."""
    return U.predict_tokens(_documents(spark, sf_dir), _tagger).withColumn("confidence", F.round("confidence", 6))


TOKENS_SQL = f"""WITH k AS (SELECT doc_id, length(text) AS n, unnest(range(CAST(ceil(length(text) / {WIDTH}.0) AS BIGINT))) AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(pos * {WIDTH} AS INT) AS start, CAST(least((pos + 1) * {WIDTH}, n) AS INT) AS "end", CASE WHEN pos % 2 = 1 THEN 'O' ELSE 'B-NAME' END AS label,
  round(0.5 + (pos * {WIDTH}) % 3 / 10.0, 6) AS confidence FROM k"""

SCHEMA = '{"title": "string"}'


def _first():
    def call(prompt):
        if len(prompt) % 3 == 0:
            raise TimeoutError("busy")
        return 'Here it is:\n```json\n{"n": ' + str(len(prompt)) + "}\n```"

    return call


def _second():
    def call(prompt):
        if len(prompt) % 5 == 0:
            raise ValueError("refused")
        return "nothing found"

    return call


def model_fallbacks(spark, sf_dir):
    """The second provider is asked where the first one fails."""
    rows = docs(spark, sf_dir).withColumn("document_type", F.lit("계약서"))
    return U.extract_with_model(rows, SCHEMA, [("first", _first), ("second", _second)]).select("doc_id", "metadata", "model_used", "error")


def _echo():
    """Answers with what stands between the lines of the prompt, in prose and fences."""

    def call(prompt):
        return "Here:\n```json\n" + prompt.split("\n---\n")[1] + "\n```"

    return call


def model_validation(spark, sf_dir):
    """Answers of a model validated by the schema of their document, all eight of them."""
    rows = view(spark, sf_dir, ANSWERS).withColumnRenamed("schema", "document_type")
    answers = U.extract_with_model(rows, SCHEMA, [("echo", _echo)])
    checked = R.validate_answers(answers, "document_type")
    return checked.select("doc_id", F.col("document_type").alias("schema"), F.array_join("_validation_errors", "; ").alias("errors"), F.round("completeness", 6).alias("completeness"))


def _if(n: int, error: str) -> str:
    return f"CASE WHEN k % {n} = 0 THEN '{error}' END"


_PARTY_ERRORS = [_if(8, "parties/1/name: is required")]
_BOX_ERRORS = [_if(10, "checkbox_info.pattern_detected: is not one of the allowed values"), _if(12, "checkbox_info.extraction_confidence: is too large")]
_CONTRACT_ERRORS = [_if(4, "contract_type: is not of type string"), _if(5, "user: is required"), _if(13, "payment_amount: is not of type number"), _if(6, "granted_rights: is not of type object"), *_PARTY_ERRORS]
_CONSENT_ERRORS = ["CASE WHEN k % 3 = 1 THEN 'consent_status: is not one of the allowed values' END", *_PARTY_ERRORS]
_GENERAL_ERRORS = [_if(3, "document_type: is required"), *_PARTY_ERRORS]
_EXPECTED = {
    "contract": ([*_CONTRACT_ERRORS, _if(12, "confidence: is too large")], "4 + CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END + 2", 18),
    "contract_enhanced": ([*_CONTRACT_ERRORS, *_BOX_ERRORS], "4 + CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END + 2", 18),
    "consent": (_CONSENT_ERRORS, "5", 15),
    "consent_enhanced": ([*_CONSENT_ERRORS, *_BOX_ERRORS], "5", 15),
    "general": (_GENERAL_ERRORS, "2 + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END", 9),
    "general_enhanced": ([*_GENERAL_ERRORS, *_BOX_ERRORS], "2 + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END", 9),
    "copyright_transfer": (
        [*_GENERAL_ERRORS, *_BOX_ERRORS, "'copyright_transfer: is required'", "'consent_info: is required'", _if(7, "work_info.work_title: is required"), _if(2, "work_info.work_type: is not one of the allowed values"), "'parties/1/role: is not one of the allowed values'"],
        "3 + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END", 10,
    ),
    "public_copyright": ([*_PARTY_ERRORS, "'copyright_license: is required'", "'public_nuri_license: is required'", _if(9, "work_display.work_names: is not of type array"), "'work_display.work_category: is required'"], "4", 12),
}
_VALIDATED = " UNION ALL ".join(
    f"SELECT k, schema, [{', '.join(errors)}] AS e, round(({filled}) / {n}.0, 6) AS completeness FROM a WHERE schema = '{name}'" for name, (errors, filled, n) in _EXPECTED.items()
)
VALIDATED_SQL = f"""WITH a AS (SELECT doc_id AS k, schema FROM ({ANSWERS})), e AS ({_VALIDATED})
SELECT k AS doc_id, schema, array_to_string(list_sort(list_filter(e, lambda x: x IS NOT NULL)), '; ') AS errors, completeness FROM e"""

_PROMPT = f"""'Read the document below, which is a ' || '계약서' || '.' || chr(10) || 'Answer with one JSON object for this schema and with nothing else:' || chr(10) || '{SCHEMA}' || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10)"""
FALLBACK_SQL = f"""WITH {DOCS}, p AS (SELECT doc_id, length({_PROMPT}) AS n FROM docs WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n % 3 <> 0 THEN '{{"n": ' || CAST(n AS STRING) || '}}' ELSE '{{}}' END AS metadata, CASE WHEN n % 3 <> 0 THEN 'first' ELSE 'second' END AS model_used,
  CASE WHEN n % 15 = 0 THEN 'ValueError: refused' END AS error FROM p"""


def prompts(spark, sf_dir):
    """T20."""
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.md5(T.build_prompt(F.col("text"), SCHEMA, F.lit("계약서"))).alias("digest"))


PROMPTS_SQL = f"WITH {DOCS} SELECT doc_id, md5({_PROMPT}) AS digest FROM docs WHERE text IS NOT NULL"


def _pager():
    def pages(content):
        if len(content) % 7 == 0:
            raise ValueError("broken")
        return [content[k : k + PAGE] for k in range(0, len(content), PAGE)]

    return pages


def _reader():
    def read(content):
        if len(content) < PAGE:
            raise ValueError("short")
        return f"{len(content)} bytes"

    return read


def _files(spark, sf_dir):
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def document_pages(spark, sf_dir):
    """U4: documents rendered page by page; a broken one is page 0 with its error."""
    return U.read_pages_of(_files(spark, sf_dir), _pager).select("doc_id", "page_number", F.length("content").alias("n_bytes"), "error")


PAGES_SQL = f"""WITH d AS (SELECT CAST(doc_id AS STRING) AS doc_id, strlen(coalesce(text, '')) AS n FROM documents), k AS (SELECT doc_id, n, unnest(range(CAST(ceil(n / {PAGE}.0) AS BIGINT))) AS i FROM d WHERE n % 7 <> 0)
SELECT doc_id, CAST(i + 1 AS INT) AS page_number, CAST(least({PAGE}, n - i * {PAGE}) AS INT) AS n_bytes, CAST(NULL AS STRING) AS error FROM k
UNION ALL SELECT doc_id, 0, NULL, 'ValueError: broken' FROM d WHERE n % 7 = 0"""


def page_texts(spark, sf_dir):
    """U3 over the pages of U4."""
    return U.ocr_pages(U.read_pages_of(_files(spark, sf_dir), _pager).filter("error IS NULL"), _reader, "rule")


TEXTS_SQL = f"""WITH p AS ({PAGES_SQL}) SELECT doc_id, page_number, 'rule' AS provider, CASE WHEN n_bytes = {PAGE} THEN '{PAGE} bytes' ELSE '' END AS extracted_text, CASE WHEN n_bytes = {PAGE} THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN n_bytes < {PAGE} THEN 'ValueError: short' END AS error FROM p WHERE page_number > 0"""


#: Documents made of customers, each a file of its own.
_PAPERS = DOCUMENTS.replace("FROM orders JOIN customer ON o_custkey = c_custkey", "FROM (SELECT c_custkey AS o_orderkey FROM customer)")


def _papers(spark, sf_dir):
    """(name, content, doc_id): documents as text files below a folder."""
    return view(spark, sf_dir, _PAPERS).filter("text IS NOT NULL").select(F.expr("substr(path, 2)").alias("name"), F.col("text").alias("content"), "doc_id")


def stored_records(spark, sf_dir):
    """Files streamed to one record file each, by name, and read back."""
    at = X.scratch(spark)
    write_files(_papers(spark, sf_dir), f"{at}/in")
    metadata_stream(spark, f"{at}/in", f"{at}/out", f"{at}/check").awaitTermination()
    rows = X.read_files(X.list_files(spark, f"{at}/out", (".json",)))
    field = lambda name: F.get_json_object(F.col("content").cast("string"), f"$.{name}")
    return rows.select(F.regexp_extract("path", r"/out/(.*)\z", 1).alias("file"), field("identifier").alias("identifier"), field("effective_date").alias("effective_date"), field("subject.name").alias("subject"), field("multi_subject_index").cast("int").alias("place"))


_OF_PAPERS = lambda sql: sql.replace(DOCS, f"docs AS ({_PAPERS})")
_STORED = "replace(substr(path, 2), '.txt', '')"
STORED_SQL = f"""WITH p AS ({_PAPERS}), c AS ({_OF_PAPERS(CONTRACT_SQL)}), s AS ({_OF_PAPERS(CONSENT_SQL)}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM s)
SELECT {_STORED} || '.json' AS file, identifier, effective_date, CAST(NULL AS STRING) AS subject, CAST(NULL AS INT) AS place FROM c JOIN p USING (doc_id)
UNION ALL SELECT {_STORED} || CASE WHEN n > 1 THEN '__' || lpad(CAST(multi_subject_index AS STRING), 2, '0') ELSE '' END || '.json', identifier, NULL, name, CAST(multi_subject_index AS INT) FROM n JOIN p USING (doc_id)"""


def stored_entities(spark, sf_dir):
    """Entities of each document written beside its path, and the inventory of what was written."""
    at = X.scratch(spark)
    d = view(spark, sf_dir, _PAPERS)
    write_entity_results(extract_entities(d), d, f"{at}/out", "/srv/data")
    rows = X.inventory_files(spark, f"{at}/out")
    told = X.read_files(rows).select("path", F.col("content").cast("string").alias("value"))
    texts = told.select("path", F.get_json_object("value", "$.entity_count").cast("int").alias("entity_count"), F.get_json_object("value", "$.file").alias("source"))
    return rows.join(texts, "path").select(F.regexp_extract("path", r"/out/(.*)\z", 1).alias("file"), "kind", "entity_count", "source")


STORED_ENTITIES_SQL = f"""WITH {_OF_PAPERS(FOUND)}, n AS (SELECT doc_id, count(*) AS n FROM ent GROUP BY doc_id)
SELECT replace(replace(path, '/srv/data/', ''), '.txt', '') || '_entities.json' AS file, 'unsupported' AS kind, CAST(n AS INT) AS entity_count, path AS source FROM n JOIN docs USING (doc_id)"""


def ocr_tree(spark, sf_dir):
    """A tree of OCR results by provider and category, two of its four providers read."""
    at = X.scratch(spark)
    rows = view(spark, sf_dir, _PAPERS).filter("text IS NOT NULL")
    part = F.split("path", "/")
    name = F.concat_ws("/", F.concat(F.lit("engine"), F.col("doc_id") % 4), part[3], F.col("doc_id").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit("_extracted_text.txt")))
    write_files(rows.select(name.alias("name"), F.col("text").alias("content")), at)
    found = X.scan_ocr_results(spark, at, ["engine1", "engine3"])
    return found.select("provider", "category", "doc", F.md5("text").alias("digest"))


TREE_SQL = f"""WITH p AS ({_PAPERS}) SELECT 'engine' || CAST(doc_id % 4 AS STRING) AS provider, string_split(path, '/')[4] AS category, CAST(doc_id AS STRING) AS doc, md5(text) AS digest FROM p WHERE text IS NOT NULL AND doc_id % 4 IN (1, 3)"""


def text_corpus(spark, sf_dir):
    """A folder of texts, blank and short ones left out."""
    at = X.scratch(spark)
    rows = view(spark, sf_dir, "SELECT c_custkey FROM customer").select(F.concat(F.col("c_custkey") % 9, F.lit("/"), "c_custkey", F.when(F.col("c_custkey") % 5 == 0, ".pdf").when(F.col("c_custkey") % 2 == 0, ".md").otherwise(".txt")).alias("name"), F.expr("repeat('글 ', int(c_custkey % 8))").alias("content"))
    write_files(rows, at)
    return X.read_text_corpus(spark, at).select(F.regexp_extract("path", r"([^/]*/[^/]*)\z", 1).alias("name"), "text")


CORPUS_SQL = """WITH c AS (SELECT CAST(c_custkey % 9 AS STRING) || '/' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '.md' ELSE '.txt' END AS name, repeat('글 ', CAST(c_custkey % 8 AS INT)) AS text FROM customer WHERE c_custkey % 5 <> 0)
SELECT * FROM c WHERE length(trim(text)) >= 10"""


def field_csv_round_trip(spark, sf_dir):
    """Two CSV files with different columns, written and read as one."""
    at = X.scratch(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("document_id"), F.concat(F.lit('a "b", '), "c_name", F.lit("\n끝")).alias("name"), "c_mktsegment")
    c.filter("document_id % 2 = 0").drop("c_mktsegment").write.option("header", "true").option("escape", '"').csv(f"{at}/even")
    c.filter("document_id % 2 = 1").write.option("header", "true").option("escape", '"').csv(f"{at}/odd")
    return X.read_field_csv(spark, f"{at}/even", f"{at}/odd").withColumn("document_id", F.col("document_id").cast("bigint"))


CSV_SQL = """SELECT c_custkey AS document_id, 'a "b", ' || c_name || chr(10) || '끝' AS name, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer"""


def request_log(spark, sf_dir):
    """Request entries written as JSON lines and read back."""
    at = X.scratch(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("log_"), "user_id").alias("log_file"), F.col("event_type").alias("method"), (F.col("event_id") % 600).cast("int").alias("status"), F.col("props").alias("body")).write.json(at)
    return X.read_request_log(spark, at, False).select("timestamp", "log_file", "method", "path", "status", "body")


LOG_SQL = "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'log_' || CAST(user_id AS STRING) AS log_file, event_type AS method, CAST(NULL AS STRING) AS path, CAST(event_id % 600 AS INT) AS status, props AS body FROM events"


def training_versions(spark, sf_dir):
    """New samples after existing ones, with columns that either lacks."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old, new = c.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name"), c.filter("c_custkey % 3 = 0").select("c_custkey", "c_mktsegment")
    return L.append_training_data(old, new)


VERSIONS_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer"


def trimmed_records(spark, sf_dir):
    """T15 on plain, nested and repeated fields."""
    pad = lambda c: F.concat(F.lit(" \t"), c, F.lit("\n "))
    rows = _answers(spark, sf_dir).select(
        "doc_id", pad("rights_holder").alias("rights_holder"), F.struct(pad("contract_type").alias("work_title")).alias("work_info"),
        F.struct(F.array(pad(F.lit("가")), pad(F.col("doc_id").cast("string"))).alias("work_names")).alias("work_display"),
    )
    return T.trim_record_fields(rows).select("doc_id", "rights_holder", "work_info.work_title", F.array_join("work_display.work_names", ";").alias("work_names"))


TRIM_SQL = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN '가온' END AS rights_holder, CASE WHEN o_orderkey % 4 <> 0 THEN '매매' END AS work_title, '가;' || CAST(o_orderkey AS STRING) AS work_names FROM orders"


def monthly_spend(spark, sf_dir):
    prices = spark.createDataFrame([("alpha", 5.0), ("beta", 2.5)], "provider string, price double")
    return R.monthly_spend(view(spark, sf_dir, CALLS), prices, 50.0).withColumn("month", F.date_format("month", "yyyy-MM"))


MONTH_SQL = f"""WITH c AS ({CALLS}), s AS (SELECT date_trunc('month', ts) AS m, round(sum(length(text) / 4 * CASE provider WHEN 'alpha' THEN 5.0 WHEN 'beta' THEN 2.5 ELSE 0.0 END / 1000), 6) AS cost FROM c GROUP BY m)
SELECT strftime(m, '%Y-%m') AS month, cost, cost > 50.0 AS alert FROM s"""

QUERIES = {
    "model_tokens": model_tokens, "model_fallbacks": model_fallbacks, "prompts": prompts, "document_pages": document_pages, "page_texts": page_texts, "field_csv_round_trip": field_csv_round_trip,
    "request_log": request_log, "training_versions": training_versions, "trimmed_records": trimmed_records, "monthly_spend": monthly_spend, "model_validation": model_validation, "stored_records": stored_records, "stored_entities": stored_entities, "ocr_tree": ocr_tree, "text_corpus": text_corpus,
}
SQL = {
    "model_tokens": TOKENS_SQL, "model_fallbacks": FALLBACK_SQL, "prompts": PROMPTS_SQL, "document_pages": PAGES_SQL, "page_texts": TEXTS_SQL, "field_csv_round_trip": CSV_SQL, "request_log": LOG_SQL,
    "training_versions": VERSIONS_SQL, "trimmed_records": TRIM_SQL, "monthly_spend": MONTH_SQL, "model_validation": VALIDATED_SQL, "stored_records": STORED_SQL, "stored_entities": STORED_ENTITIES_SQL, "ocr_tree": TREE_SQL, "text_corpus": CORPUS_SQL,
}
