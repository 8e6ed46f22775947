"""Queries on entities, labelled fields and checkboxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checkboxes as B
from ..operators import entities as E
from ..operators import fields as L
from ..functions.classify import CONSENT, CONTRACT, detect_doc_type
from .metadata import _WS, DOCS, TYPED, docs
from .rendered import DOCUMENTS, view


KINDS = f"{DOCS}, {TYPED.replace('typed AS', 'kinds AS').replace('FROM masked', 'FROM docs')}"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _ends(words) -> str:
    return " OR ".join(f"ends_with(value, '{w}')" for w in words)


def _has(words) -> str:
    return " OR ".join(f"contains(value, '{w}')" for w in words)


_TITLES = "씨|님|선생|교수|박사|의원|대표|이사|부장|과장|대리|주임|팀장"


def _found(r: E.Rule) -> str:
    pattern = r.pattern.replace(f"(?=\\s*(?:{_TITLES}))", f"\\s*(?:{_TITLES})")
    value = "v"
    for w in r.drop:
        value = f"replace({value}, '{w}', '')"
    return f"SELECT doc_id, '{r.type}' AS type, trim({value}, {_WS}) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', {r.group})) AS v FROM docs WHERE text IS NOT NULL)"


_VALID = f"""length(value) BETWEEN 2 AND 50 AND length(value) - length(replace(value, chr(10), '')) <= CASE WHEN type = 'ADDRESS' THEN 1 ELSE 2 END AND NOT ({_has(E.GLYPHS)})
  AND NOT regexp_matches(value, '^\\d+$') AND NOT regexp_matches(value, '^\\d+[년월일원]$') AND NOT ({_ends(E.BAD_ENDS)}) AND substr(value, 1, 1) NOT IN ({_list(E.BAD_STARTS)}) AND value NOT IN ({_list(E.PARTICLES)}) AND trim(value, {_WS}) <> ''
  AND CASE type WHEN 'NAME' THEN value NOT IN ({_list(E.NAME_VERBS + E.NAME_ROLES)}) AND NOT (regexp_matches(value, '(자|인|처)$') AND length(value) <= 4 AND value NOT IN ({_list(E.NAME_EXCEPTIONS)})) AND NOT contains(value, '.') AND NOT contains(value, ',')
    WHEN 'COMPANY' THEN value NOT IN ({_list(E.COMPANY_NOUNS)}) AND NOT contains(value, '연락처') AND NOT contains(value, '주소') AND NOT ends_with(value, '로부') AND NOT (contains(value, '법원') AND length(value) <= 6) AND NOT (ends_with(value, '처') AND length(value) <= 3) AND (length(value) >= 4 OR value IN ({_list(E.SHORT_COMPANIES)}))
    WHEN 'PHONE' THEN NOT regexp_matches(value, '^\\d{{4}}\\.\\s*\\d{{1,2}}\\.\\s*\\d{{1,2}}') AND length(regexp_replace(value, '\\D', '', 'g')) >= 7 AND NOT regexp_matches(value, '\\d{{2,4}}\\.\\s*\\d{{4}}')
    WHEN 'DATE' THEN lower(value) NOT IN ({_list(E.FILE_ENDINGS)}) ELSE true END"""
_SHAPE = "CASE type WHEN 'NAME' THEN length(value) >= 2 AND regexp_matches(value, '^[가-힣A-Za-z]+$') WHEN 'PHONE' THEN regexp_matches(value, '^[0-9-]{10,15}$') WHEN 'ADDRESS' THEN length(value) > 5 WHEN 'COMPANY' THEN length(value) > 2 WHEN 'DATE' THEN length(value) > 4 WHEN 'MONEY' THEN contains(value, '원') AND length(value) > 2 ELSE true END"
FOUND = f"{DOCS}, raw AS ({' UNION ALL '.join(_found(r) for r in E.RULES)}), ent AS (SELECT DISTINCT doc_id, value, type FROM raw WHERE {_SHAPE} AND (type IN ('EMAIL', 'MONEY') OR ({_VALID})))"
# made-up model output: the companies in another case, and every third document's phone as another type
_MODEL = "model AS (SELECT doc_id, CASE type WHEN 'EMAIL' THEN upper(value) ELSE value END AS value, CASE type WHEN 'EMAIL' THEN 'EMAIL' ELSE 'CONTACT_INFO' END AS type FROM ent WHERE type = 'EMAIL' OR (type = 'PHONE' AND doc_id % 3 = 0))"


def rule_entities(spark, sf_dir):
    return E.extract_entities(docs(spark, sf_dir))


def extract_entities(spark, sf_dir):
    # the queries below group entities by document, so they send them anyway
    return E.extract_entities(view(spark, sf_dir, DOCUMENTS, copies=True), copies="copies").select("doc_id", "value", "type")


def _merged(spark, sf_dir):
    mail = F.col("type") == "EMAIL"
    rule = F.struct("value", "type", F.lit(1).alias("rank"))
    model = F.struct(F.when(mail, F.upper("value")).otherwise(F.col("value")).alias("value"), F.when(mail, "EMAIL").otherwise("CONTACT_INFO").alias("type"), F.lit(0).alias("rank"))
    # both sources come of one pass over the texts
    both = F.when(mail | ((F.col("type") == "PHONE") & (F.col("doc_id") % 3 == 0)), F.array(rule, model)).otherwise(F.array(rule))
    return E.merge_ranked(rule_entities(spark, sf_dir).select("doc_id", F.inline(both)))


def merge_entities(spark, sf_dir):
    return _merged(spark, sf_dir)


MERGE = f"{FOUND}, {_MODEL}, allrows AS (SELECT *, 0 AS k FROM model UNION ALL SELECT *, 1 FROM ent), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(value, {_WS})) ORDER BY k, type, value) AS n FROM allrows)"
MERGE_SQL = f"WITH {MERGE} SELECT doc_id, value, type, CASE k WHEN 0 THEN 'model' ELSE 'rule' END AS source FROM best WHERE n = 1"


def entities_by_type(spark, sf_dir):
    rows = E.group_entities_by_type(rule_entities(spark, sf_dir))
    return rows.select("doc_id", "entity_count", "entity_types", F.explode("entities").alias("type", "v")).select("doc_id", "entity_count", "entity_types", "type", F.array_join("v", "|").alias("values_text"))


BY_TYPE_SQL = f"""WITH {FOUND}, t AS (SELECT doc_id, type, string_agg(value, '|' ORDER BY value COLLATE "C") AS values_text, count(*) AS n FROM ent GROUP BY doc_id, type)
SELECT doc_id, CAST(sum(n) OVER (PARTITION BY doc_id) AS INT) AS entity_count, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS entity_types, type, values_text FROM t""".replace(' COLLATE "C"', "")


def entity_summary(spark, sf_dir):
    return E.corpus_entity_summary(rule_entities(spark, sf_dir))


ENTITY_SUMMARY_SQL = f"WITH {FOUND} SELECT type, count(DISTINCT doc_id) AS documents, count(*) AS mentions, count(DISTINCT value) AS distinct_values FROM ent GROUP BY ROLLUP (type)"


def merge_document_entities(spark, sf_dir):
    return E.sort_entities(E.merge_document_entities(rule_entities(spark, sf_dir)).withColumn("doc_id", F.lit(0))).drop("doc_id")


def filter_entities(spark, sf_dir):
    scored = rule_entities(spark, sf_dir).withColumn("confidence", F.when(F.col("type") != "EMAIL", (F.col("doc_id") % 10) / 10))
    return E.filter_entities(scored, ["NAME", "EMAIL"], 0.85).select("doc_id", "value", "type")


def _kinds(spark, sf_dir):
    """Documents with their kind, which each query reads in one pass."""
    return docs(spark, sf_dir).withColumn("document_type", detect_doc_type(F.col("text")))


def _of_kind(spark, sf_dir, kind: str):
    return _kinds(spark, sf_dir).filter(F.col("document_type") == kind)


def _contracts(spark, sf_dir):
    return _of_kind(spark, sf_dir, CONTRACT)


def _consents(spark, sf_dir):
    return _of_kind(spark, sf_dir, CONSENT)


def fields_simple(spark, sf_dir):
    return L.extract_fields_simple(_kinds(spark, sf_dir))


def _simple_sql(kind: str) -> str:
    where = "document_type = '계약서'" if kind == "contract" else "document_type = '동의서'"
    return " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, trim(regexp_extract(text, '{p}', 1), {_WS}) AS value FROM kinds WHERE {where} AND regexp_matches(text, '{p}')" for label, p in L.SIMPLE[kind])


SIMPLE_SQL = f"WITH {KINDS} {_simple_sql('contract')} UNION ALL {_simple_sql('consent')}"


def fields_ranked(spark, sf_dir):
    return L.extract_fields_ranked(_kinds(spark, sf_dir))


def _ranked_parts(kind: str) -> list[str]:
    where = "document_type = '계약서'" if kind == "contract" else "document_type = '동의서'"
    return [
        f"SELECT doc_id, '{label}' AS label, {i} AS pattern_rank, trim(regexp_extract(text, '{p}', 1, 'is'), {_WS}) AS value FROM kinds WHERE {where} AND length(trim(regexp_extract(text, '{p}', 1, 'is'), {_WS})) > 1"
        for label, ps in L.RANKED[kind].items() for i, p in enumerate(ps)
    ]


RANKED = f"{KINDS}, cand AS ({' UNION ALL '.join(_ranked_parts('contract') + _ranked_parts('consent'))})"


def fields_best_ranked(spark, sf_dir):
    return L.rank_candidates(fields_ranked(spark, sf_dir))


def fields_best(spark, sf_dir):
    return L.extract_fields_best(_kinds(spark, sf_dir))


def _best_parts(kind: str) -> list[str]:
    where, out = "document_type = '계약서'" if kind == "contract" else "document_type = '동의서'", []
    for label, ps in L.BEST[kind].items():
        tries = []
        for p in ps:
            q = p.replace("\\z", "$")
            tries.append(f"list_filter(list_transform(regexp_extract_all(text, '{q}', 1, 'is'), lambda v: trim(regexp_replace(v, '\\s+', ' ', 'g'))), lambda v: length(v) > 1 AND length(v) < 200)[1]")
        out.append(f"SELECT * FROM (SELECT doc_id, '{label}' AS label, coalesce({', '.join(tries)}) AS value FROM kinds WHERE {where}) WHERE value IS NOT NULL")
    return out


BEST_SQL = f"WITH {KINDS} " + " UNION ALL ".join(_best_parts("contract") + _best_parts("consent"))




def _hit_parts(kind: str) -> list[str]:
    where = "document_type = '계약서'" if kind == "contract" else "document_type = '동의서'"
    found = lambda p: f"SELECT doc_id, list_transform(regexp_extract_all(text, '{p}', 1, 'is'), lambda v: trim(v, {_WS})) AS h FROM kinds WHERE {where}"
    return [
        f"SELECT * FROM (SELECT doc_id, '{label}' AS label, {i} AS pattern_rank, unnest(range(len(h))) AS hit, unnest(h) AS value FROM ({found(p)})) WHERE length(value) > 1"
        for label, ps in L.RANKED[kind].items() for i, p in enumerate(ps)
    ]


def fields_earliest(spark, sf_dir):
    """W3 over all matches: the earliest of the first pattern that has any."""
    return L.rank_candidates(L.field_candidates(_kinds(spark, sf_dir)))


EARLIEST_SQL = f"WITH {KINDS}, hits AS ({' UNION ALL '.join(_hit_parts('contract') + _hit_parts('consent'))}) SELECT doc_id, label, arg_min(value, pattern_rank * 1000000 + hit) AS value FROM hits GROUP BY doc_id, label"


def fields_wide(spark, sf_dir):
    """The first match of each label of a contract."""
    labels = list(L.RANKED["contract"])
    wide = L.fields_wide(L.field_candidates(_contracts(spark, sf_dir), "contract"), labels, ("pattern_rank", "hit"))
    return wide.select("doc_id", *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(labels)])


WIDE_SQL = f"WITH {KINDS}, hits AS ({' UNION ALL '.join(_hit_parts('contract'))}) SELECT doc_id, " + ", ".join(f"coalesce(arg_min(value, pattern_rank * 1000000 + hit) FILTER (WHERE label = '{c}'), '') AS f{i}" for i, c in enumerate(L.RANKED["contract"])) + " FROM hits GROUP BY doc_id"


def labelled_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return L.rows_to_labelled_text(rows, ["name", "segment", "nation"], "c_custkey").select("doc_id", "text", "label", "value", "start", F.col("end").alias("stop"))


LABELLED_SQL = """WITH r AS (SELECT c_custkey AS doc_id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS segment, CAST(c_nationkey AS STRING) AS nation FROM customer),
u AS (SELECT doc_id, concat_ws(' ', name, nullif(segment, ''), nation) AS text, 'name' AS label, name AS value, 0 AS start FROM r
  UNION ALL SELECT doc_id, concat_ws(' ', name, nullif(segment, ''), nation), 'segment', segment, length(name) + 1 FROM r WHERE segment <> ''
  UNION ALL SELECT doc_id, concat_ws(' ', name, nullif(segment, ''), nation), 'nation', nation, length(name) + 1 + CASE WHEN segment = '' THEN 0 ELSE length(segment) + 1 END FROM r)
SELECT doc_id, text, label, value, CAST(start AS INT) AS start, CAST(start + length(value) AS INT) AS stop FROM u"""


def diff_corrections(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = c.select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment")
    new = c.filter("c_custkey % 10 <> 1").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return L.diff_corrections(old, new, ["c_name", "c_mktsegment"])


DIFF_SQL = """WITH o AS (SELECT c_custkey AS doc_id, 'c_name' AS label, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer),
n AS (SELECT c_custkey AS doc_id, 'c_name' AS label, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS v FROM customer WHERE c_custkey % 10 <> 1
  UNION ALL SELECT c_custkey, 'c_mktsegment', CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END FROM customer WHERE c_custkey % 10 <> 1)
SELECT doc_id, label, o.v AS old, n.v AS "new" FROM o FULL JOIN n USING (doc_id, label) WHERE o.v IS DISTINCT FROM n.v"""

_GLYPHS = "|".join(B.TICKED["A"])


def _ticked(names) -> str:
    return f"regexp_matches(text, '(?:{_GLYPHS})\\s*(?:{'|'.join(names)})')"


def checkboxes(spark, sf_dir):
    return B.extract_checkboxes(_contracts(spark, sf_dir), "contract").unionByName(B.extract_checkboxes(_consents(spark, sf_dir), "consent"))


def _boxes(kind: str) -> str:
    where = "document_type = '계약서'" if kind == "contract" else "document_type = '동의서'"
    return " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{k}' AS key, {_ticked(n)} AS checked FROM kinds WHERE {where} AND text IS NOT NULL" for c, keys in B.ITEMS[kind].items() for k, n in keys.items())


BOXES = f"{KINDS}, boxes AS ({_boxes('contract')} UNION ALL {_boxes('consent')})"


def checkbox_summary(spark, sf_dir):
    return B.checkbox_summary(checkboxes(spark, sf_dir))


def checkbox_glyphs(spark, sf_dir):
    return docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", B.checkbox_pattern(F.col("text")).alias("pattern"), B.dominant_glyph(F.col("text")).alias("glyph"))


_COUNT = lambda g: f"length(text) - length(replace(text, '{g}', ''))"
GLYPH_SQL = f"WITH {DOCS} SELECT doc_id, 'A' AS pattern, CASE WHEN {_COUNT('📧')} = 0 AND {_COUNT('☑')} = 0 THEN NULL WHEN {_COUNT('📧')} >= {_COUNT('☑')} THEN '📧' ELSE '☑' END AS glyph FROM docs WHERE text IS NOT NULL"


def work_display(spark, sf_dir):
    rows = B.extract_work_display(docs(spark, sf_dir).filter("text IS NOT NULL"))
    return rows.withColumn("work_names", F.array_join("work_names", ";")).select("*", "components.*").drop("components")


_TITLED = "contains(n, '<') AND contains(n, '>')"
WORK_SQL = rf"""WITH {DOCS}, w AS (SELECT doc_id, text, trim(regexp_extract(text, '저작물명\s*:\s*(.*?)(?:○|$)', 1, 's'), {_WS}) AS n FROM docs WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN {_TITLED} THEN trim(regexp_extract(n, '([^<]+)<([^>]+)>', 1)) END AS institution, CASE WHEN {_TITLED} THEN trim(regexp_extract(n, '([^<]+)<([^>]+)>', 1)) || '<' || trim(regexp_extract(n, '([^<]+)<([^>]+)>', 2)) || '>' END AS work_names,
  CASE WHEN contains(text, '우대미술') THEN '우대미술' WHEN contains(text, '의상') AND contains(text, '디자인') THEN '의상디자인' END AS work_category,
  nullif(trim(regexp_extract(text, '상세정보\s*:\s*(.*?)(?:□|$)', 1, 's'), {_WS}), '') AS detailed_info, {' + '.join(f"CAST({_ticked(n)} AS INT)" for n in B.ITEMS["public_copyright_consent"]["work_details"].values())} AS n_components,
  {', '.join(f"{_ticked(n)} AS {k}" for k, n in B.ITEMS["public_copyright_consent"]["work_details"].items())} FROM w"""


def license_terms(spark, sf_dir):
    return B.extract_license(docs(spark, sf_dir).filter("text IS NOT NULL"))


LICENSE_SQL = f"""WITH {DOCS} SELECT doc_id, CAST(NULL AS STRING) AS license_purpose, CASE WHEN contains(text, '국립극장') THEN '국립극장' END AS licensing_institution, {', '.join(f"{_ticked(n)} AS {k}" for k, n in B.RIGHTS.items())}, '비독점적 이용허락' AS license_type FROM docs WHERE text IS NOT NULL"""


def open_license(spark, sf_dir):
    return B.extract_open_license(docs(spark, sf_dir).filter("text IS NOT NULL"))


OPEN_SQL = rf"""WITH {DOCS} SELECT doc_id, CAST(NULL AS STRING) AS license_purpose, CASE {' '.join(f"WHEN {_ticked([f'제{i}유형'])} THEN '제{i}유형'" for i in (4, 3, 2, 1))} END AS nuri_type,
  array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(제[1-4]유형)', 1))), ',') AS available_types, regexp_matches(text, '동일성유지권.*동의') AS integrity_right_waiver, regexp_matches(text, '변경.*가능') AS modification_allowed, CAST(NULL AS STRING) AS conditions FROM docs WHERE text IS NOT NULL"""

QUERIES = {
    "extract_entities": extract_entities, "merge_entities": merge_entities, "entities_by_type": entities_by_type, "entity_summary": entity_summary, "merge_document_entities": merge_document_entities,
    "filter_entities": filter_entities, "fields_simple": fields_simple, "fields_ranked": fields_ranked, "fields_first_rank": fields_best_ranked, "fields_best": fields_best, "fields_earliest": fields_earliest, "fields_wide": fields_wide,
    "labelled_text": labelled_text, "diff_corrections": diff_corrections, "checkboxes": checkboxes, "checkbox_summary": checkbox_summary, "checkbox_glyphs": checkbox_glyphs, "work_display": work_display,
    "license_terms": license_terms, "open_license": open_license,
}
SQL = {
    "extract_entities": f"WITH {FOUND} SELECT doc_id, value, type FROM ent", "merge_entities": MERGE_SQL, "entities_by_type": BY_TYPE_SQL, "entity_summary": ENTITY_SUMMARY_SQL,
    "merge_document_entities": f"WITH {FOUND} SELECT type, value, count(DISTINCT doc_id) AS documents FROM ent GROUP BY type, value",
    "filter_entities": f"WITH {FOUND} SELECT doc_id, value, type FROM ent WHERE type = 'EMAIL' OR (type = 'NAME' AND doc_id % 10 = 9)",
    "fields_simple": SIMPLE_SQL, "fields_ranked": f"WITH {RANKED} SELECT * FROM cand",
    "fields_first_rank": f"WITH {RANKED} SELECT doc_id, label, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY pattern_rank, value) AS n FROM cand) WHERE n = 1",
    "fields_best": BEST_SQL, "fields_earliest": EARLIEST_SQL, "fields_wide": WIDE_SQL, "labelled_text": LABELLED_SQL, "diff_corrections": DIFF_SQL, "checkboxes": f"WITH {BOXES} SELECT * FROM boxes",
    "checkbox_summary": f"WITH {BOXES} SELECT doc_id, string_agg(category || '.' || key, ',' ORDER BY category || '.' || key) AS fields, count(*) FILTER (WHERE checked) AS n_checked, least(1.0, count(*) / 10.0) AS confidence FROM boxes GROUP BY doc_id",
    "checkbox_glyphs": GLYPH_SQL, "work_display": WORK_SQL, "license_terms": LICENSE_SQL, "open_license": OPEN_SQL,
}
