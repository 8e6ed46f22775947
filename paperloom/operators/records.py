"""Record routing and validation by rule tables, extraction summaries, request logs and spend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions.classify import schema_for_document_type
from ..functions.text import estimate_cost, field_completeness


@dataclass(frozen=True)
class FieldRule:
    """A field: whether it has to be there, the values it may have, and its bounds.

    ``a.b`` is field b of the object a, ``a[].b`` field b of every object in the list a; they are asked for only where a is.
    """

    field: str
    required: bool = False
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


def _required(*fields: str) -> list[FieldRule]:
    return [FieldRule(f, True) for f in fields]


# What the document schemas ask for.
_STATUS, _NURI = ("동의함", "동의하지 않음", "null"), ("제1유형", "제2유형", "제3유형", "제4유형")
_PATTERNS = ("pattern_a", "pattern_b", "pattern_c", "pattern_d")
_BOXES = [FieldRule("checkbox_info.pattern_detected", allowed=_PATTERNS), FieldRule("checkbox_info.extraction_confidence", low=0, high=1)]
_CONTRACT = [*_required("contract_type", "rights_holder", "user"), *_required("parties[].name")]
_CONSENT = [*_required("consent_type", "data_controller"), FieldRule("consent_status", True, _STATUS), *_required("parties[].name")]
_GENERAL = [*_required("document_type", "title"), *_required("parties[].name")]
RULES = {
    "contract": [*_CONTRACT, FieldRule("confidence", low=0, high=1)],
    "contract_enhanced": [*_CONTRACT, *_required("granted_rights"), *_BOXES],
    "consent": _CONSENT,
    "consent_enhanced": [*_CONSENT, *_BOXES],
    "general": _GENERAL,
    "general_enhanced": [*_GENERAL, *_BOXES],
    "copyright_transfer": [
        *_required("document_type", "work_info", "copyright_transfer", "consent_info", "parties", "work_info.work_title"),
        FieldRule("work_info.work_type", True, ("도서", "음악", "미술", "영상", "기타")),
        FieldRule("copyright_transfer.transfer_type", True, ("전체양도", "부분양도", "이용허락")),
        *_required("copyright_transfer.transfer_scope"),
        FieldRule("public_nuri_license.nuri_type", False, _NURI),
        FieldRule("consent_info.consent_status", True, ("동의함", "동의하지 않음", "조건부동의")),
        *_required("consent_info.consent_date", "parties[].name"),
        FieldRule("parties[].role", True, ("저작자", "출판사", "기관", "대리인", "증인")),
        *_BOXES,
    ],
    "public_copyright": [
        *_required("consent_type", "work_display", "copyright_license", "public_nuri_license", "work_display.work_names", "work_display.work_category"),
        *_required("copyright_license.license_purpose", "copyright_license.licensing_institution", "copyright_license.granted_rights"),
        FieldRule("public_nuri_license.nuri_type", True, _NURI),
        *_required("public_nuri_license.license_purpose"),
        *_required("personal_info_consent.collected_data_types", "personal_info_consent.collection_purpose", "personal_info_consent.retention_period"),
        *_required("parties[].name", "parties[].role"),
        FieldRule("processing_info.checkbox_pattern_detected", allowed=_PATTERNS),
        FieldRule("processing_info.extraction_confidence", low=0, high=1),
    ],
}
_RIGHTS = "reproduction_right performance_right broadcasting_right exhibition_right distribution_right rental_right derivative_work_right".split()


def _kinds(string: str = "", number: str = "", boolean: str = "", array: str = "", object: str = "", rights: str = "") -> dict[str, str]:
    """The type of each field, by lists of fields; the rights are booleans of the object ``rights``."""
    named = {"string": string, "number": number, "boolean": boolean, "array": array, "object": object}
    return {f: kind for kind, fields in named.items() for f in fields.split()} | {f"{rights}.{r}": "boolean" for r in _RIGHTS if rights}


_PARTIES = "parties[].name parties[].phone parties[].address parties[].registration_no parties[].role"
_CHECKBOX = {"checkbox_info": "object", "checkbox_info.pattern_detected": "string", "checkbox_info.extraction_confidence": "number", "checkbox_info.checkbox_fields_found": "array"}
# The types of the schemas' fields.
TYPES = {
    "contract": _kinds(
        f"contract_type rights_holder user work_title work_category contract_purpose contract_duration payment_currency signature_date effective_date expiration_date {_PARTIES}",
        "payment_amount", "", "special_terms termination_conditions parties", "granted_rights contract_terms", "granted_rights",
    ),
    "consent": _kinds(
        f"consent_type data_controller data_subject collection_purpose retention_period consent_status consent_date signature withdrawal_rights consequences_of_refusal {_PARTIES}",
        "", "", "collected_data_types parties", "third_party_sharing contact_info",
    ),
    "general": _kinds(f"document_type title main_content key_dates[].date key_amounts[].currency {_PARTIES}", "key_amounts[].amount", "", "parties key_dates key_amounts important_terms", "checkbox_data"),
    "copyright_transfer": _kinds(
        f"document_type document_title work_category work_info.work_title work_info.work_type copyright_transfer.transfer_type public_nuri_license.nuri_type consent_info.consent_status consent_info.consent_date {_PARTIES}",
        "", "", "parties consent_info.consent_scope", "work_info copyright_transfer public_nuri_license consent_info contract_terms copyright_transfer.transfer_scope copyright_transfer.compensation",
    )
    | _CHECKBOX,
    "public_copyright": _kinds(
        "consent_type data_controller data_subject consent_date signature utilizing_institution work_display.institution work_display.work_category work_display.detailed_info copyright_license.license_purpose "
        "copyright_license.licensing_institution copyright_license.license_type public_nuri_license.license_purpose public_nuri_license.nuri_type personal_info_consent.collection_purpose "
        "personal_info_consent.retention_period parties[].name parties[].phone parties[].address parties[].role processing_info.checkbox_pattern_detected",
        "processing_info.extraction_confidence", "", "parties work_display.work_names public_nuri_license.available_types personal_info_consent.collected_data_types",
        "work_display copyright_license public_nuri_license personal_info_consent processing_info work_display.work_details copyright_license.granted_rights", "copyright_license.granted_rights",
    ),
}
TYPES |= {f"{name}_enhanced": TYPES[name] | _CHECKBOX for name in ("contract", "consent", "general")}
#: Top-level fields of the schemas, the denominators of completeness.
PROPERTIES = {
    "contract": "contract_type rights_holder user work_title work_category granted_rights contract_terms contract_purpose contract_duration payment_amount payment_currency signature_date effective_date expiration_date special_terms termination_conditions parties checkbox_info".split(),
    "consent": "consent_type data_controller data_subject collection_purpose collected_data_types retention_period third_party_sharing consent_status consent_date signature contact_info withdrawal_rights consequences_of_refusal parties checkbox_info".split(),
    "general": "document_type title checkbox_data parties key_dates key_amounts main_content important_terms checkbox_info".split(),
    "copyright_transfer": "document_type document_title work_category work_info copyright_transfer public_nuri_license consent_info parties contract_terms checkbox_info".split(),
    "public_copyright": "consent_type data_controller data_subject work_display copyright_license public_nuri_license personal_info_consent consent_date signature utilizing_institution parties processing_info".split(),
}


def _wrong(rule: FieldRule, value: Column, name: Column) -> list[Column]:
    """What is wrong with one value, as strings or nulls."""
    out = []
    say = lambda what: F.concat(name, F.lit(f": {what}"))
    if rule.required:
        out.append(F.when(value.isNull(), say("is required")))
    text = value.cast("string")
    if rule.allowed:
        out.append(F.when(~text.isin(*rule.allowed), say("is not one of the allowed values")))
    if rule.low is not None:
        out.append(F.when(text.try_cast("double") < rule.low, say("is too small")))
    if rule.high is not None:
        out.append(F.when(text.try_cast("double") > rule.high, say("is too large")))
    return out


def _fields(kind: DataType | None) -> set[str]:
    return set(kind.fieldNames()) if isinstance(kind, StructType) else set()


def _in_list(rule: FieldRule, top: str, inner: str, has: bool) -> Callable[[Column, Column], Column]:
    def wrong(item: Column, at: Column) -> Column:
        value = item[inner] if has else F.lit(None).cast("string")
        return F.array(*_wrong(rule, value, F.concat(F.lit(f"{top}/"), at.cast("string"), F.lit(f"/{inner}"))))

    return wrong


def _ends_in(what: str) -> Callable[[Column], Column]:
    return lambda error: error.endswith(what)


def rule_errors(rules: list[FieldRule], schema: StructType) -> Column:
    """array<string> of `field: what is wrong`; a field that the rows lack is a missing one."""
    missing, out = F.lit(None).cast("string"), []
    kinds = {f.name: f.dataType for f in schema}
    for r in rules:
        if "[]." in r.field:
            top, inner = r.field.split("[].")
            if top in kinds:
                has = inner in _fields(kinds[top].elementType)
                listed = F.flatten(F.transform(F.col(top), _in_list(r, top, inner, inner in _fields(kinds[top].elementType))))
                listed = F.coalesce(listed, F.array().cast("array<string>"))
                # by what is wrong, then by place in the list
                out += [F.filter(listed, _ends_in(what)) for what in ("required", "values", "small", "large")]
        elif "." in r.field:
            top, inner = r.field.split(".")
            if top in kinds:
                value = F.col(top)[inner] if inner in _fields(kinds[top]) else missing
                out += [F.when(F.col(top).isNotNull(), F.array(e)) for e in _wrong(r, value, F.lit(r.field))]
        else:
            out += [F.array(e) for e in _wrong(r, F.col(r.field) if r.field in kinds else missing, F.lit(r.field))]
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in out])) if out else F.array().cast("array<string>")
    return F.filter(every, lambda x: x.isNotNull())


def validate_records(df: DataFrame, schema: str) -> DataFrame:
    """The rows with ``_validation_errors``, an empty array for a valid record."""
    return df.withColumn("_validation_errors", rule_errors(RULES[schema], df.schema))


def completeness(df: DataFrame, schema: str) -> Column:
    """The share of the schema's top-level fields that a record of ``df`` has filled."""
    own = PROPERTIES[schema.removesuffix("_enhanced")]
    return field_completeness([F.col(c) for c in own if c in df.columns], len(own))


def _kind_of(value: Column) -> Column:
    """The JSON type of a variant, null for a JSON null and for what is absent."""
    kind = lambda name: (
        F.when(name.startswith("OBJECT"), F.lit("object"))
        .when(name.startswith("ARRAY"), F.lit("array"))
        .when(name.isin("STRING", "BOOLEAN"), F.lower(name))
        .when(name != "VOID", F.lit("number"))
    )
    return _with(F.schema_of_variant(value), kind)


_RULE = "struct<field: string, path: array<string>, around: array<string>, top: string, kind: string, required: boolean, allowed: array<string>, low: double, high: double>"


def answer_rules(spark: SparkSession) -> DataFrame:
    """(schema, rules, lists, fields): the rules of each schema as rows, of fixed size; ``lists`` are those for items of lists."""
    rows = []
    for schema, own in RULES.items():
        every = {r.field: r for r in own} | {f: FieldRule(f) for f in TYPES[schema] if f not in {r.field for r in own}}
        plain, listed = [], []
        for f, r in every.items():
            top, _, inner = f.rpartition("[].")
            around = inner.rpartition(".")[0]
            row = (f, inner.split("."), around.split(".") if around else None, top or None, TYPES[schema].get(f), r.required, list(r.allowed) or None, *[None if x is None else float(x) for x in (r.low, r.high)])
            (listed if top else plain).append(row)
        rows.append((schema, plain, listed, PROPERTIES[schema.removesuffix("_enhanced")]))
    return spark.createDataFrame(rows, f"schema string, rules array<{_RULE}>, lists array<{_RULE}>, fields array<string>")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; the one-element array keeps the optimizer from repeating it."""
    return F.get(F.transform(F.array(value), use), 0)


def _at(value: Column, path: Column) -> Column:
    """The variant at a path, an array of names; null where an object or name is missing.  A path as text would be parsed for every row."""
    return F.aggregate(path, value, lambda v, name: F.try_element_at(F.try_variant_get(v, F.lit("$"), "map<string,variant>"), name))


def _wrong_in_answer(rule: Column, value: Column, name: Column) -> Column:
    """What is wrong with one value of an answer, as strings or nulls; a JSON null is a missing value."""
    say = lambda *what: F.concat(name, F.lit(": "), *[F.lit(w) if isinstance(w, str) else w for w in what])

    def errors(x: Column) -> Column:
        found = x["kind"]
        number = F.when(found == "number", F.try_variant_get(x["value"], "$", "double"))
        return F.array(
            F.when(rule["required"] & found.isNull(), say("is required")),
            F.when(found != rule["kind"], say("is not of type ", rule["kind"])),
            F.when((found == "string") & ~F.array_contains(rule["allowed"], F.try_variant_get(x["value"], "$", "string")), say("is not one of the allowed values")),
            F.when(number < rule["low"], say("is too small")),
            F.when(number > rule["high"], say("is too large")),
        )

    return _with(F.struct(value.alias("value"), _kind_of(value).alias("kind")), errors)


def answer_errors(answer: Column, rules: Column, lists: Column) -> Column:
    """J5 on a model's answer, a variant: sorted array<string> of `field: what is wrong`, types included.

    Fields of an object or of a list's items are asked for only where the object or list is.
    """

    def in_list(rule: Column) -> Column:
        items = F.coalesce(F.try_variant_get(_at(answer, F.array(rule["top"])), F.lit("$"), "array<variant>"), F.array().cast("array<variant>"))
        name = lambda at: F.concat(rule["top"], F.lit("/"), at.cast("string"), F.lit("/"), F.array_join(rule["path"], "."))
        return F.flatten(F.transform(items, lambda item, at: _wrong_in_answer(rule, _at(item, rule["path"]), name(at))))

    asked = F.filter(rules, lambda r: r["around"].isNull() | F.coalesce(_kind_of(_at(answer, r["around"])) == "object", F.lit(False)))
    plain = F.flatten(F.transform(asked, lambda r: _wrong_in_answer(r, _at(answer, r["path"]), r["field"])))
    return F.array_sort(F.filter(F.concat(plain, F.flatten(F.transform(lists, in_list))), lambda e: e.isNotNull()))


def answer_completeness(answer: Column, fields: Column) -> Column:
    """The share of the schema's fields that an answer has, not null and not the empty string; 0 without fields."""

    def filled(f: Column) -> Column:
        return _with(_at(answer, F.array(f)), lambda v: _kind_of(v).isNotNull() & ~F.coalesce(F.try_variant_get(v, "$", "string") == "", F.lit(False)))

    return F.when(F.size(fields) > 0, F.size(F.filter(fields, filled)) / F.size(fields)).otherwise(0.0)


def validate_answers(df: DataFrame, schema_col: str = "schema", json_col: str = "metadata") -> DataFrame:
    """J5 and T17 on models' answers: the rows with ``_validation_errors`` and ``completeness``, by the schema that each row names.

    An answer is a JSON object as a string; what is none counts as the empty object, and a row of no known schema has nulls.
    The rules of all schemas are one small table, joined by broadcast and applied to the paths of the answer.
    """
    rules = answer_rules(df.sparkSession).select(F.col("schema").alias("_schema"), F.struct("rules", "lists", "fields").alias("_rules"))
    # the generator keeps the optimizer from parsing the answer for every rule
    rows = df.select("*", F.explode(F.array(F.coalesce(F.try_parse_json(F.col(json_col)), F.parse_json(F.lit("{}"))))).alias("_answer"))
    rows = rows.join(F.broadcast(rules), F.col(schema_col) == F.col("_schema"), "left")
    answer = F.col("_answer")
    rows = rows.withColumn("_validation_errors", answer_errors(answer, F.col("_rules.rules"), F.col("_rules.lists")))
    return rows.withColumn("completeness", F.when(F.col("_rules").isNotNull(), answer_completeness(answer, F.col("_rules.fields")))).drop("_answer", "_schema", "_rules")


def routes(spark: SparkSession) -> DataFrame:
    """(schema, required, n_fields): the rule table as rows, of fixed size."""
    rows = [(name, ",".join(r.field for r in rules if r.required and r.field.isidentifier()), len(rules)) for name, rules in RULES.items()]
    return spark.createDataFrame(rows, "schema string, required string, n_fields int")


def route_extraction(df: DataFrame, type_col: str = "document_type") -> DataFrame:
    """The rows with the schema of their document type and what it asks for."""
    return df.withColumn("schema", schema_for_document_type(F.col(type_col))).join(F.broadcast(routes(df.sparkSession)), "schema", "left")


def extraction_summary(df: DataFrame, error_col: str = "error", confidence_col: str = "confidence") -> DataFrame:
    """A4: total, success, failed, and mean confidence of the successful ones (0 without any)."""
    ok = F.col(error_col).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col(confidence_col))), F.lit(0.0)), 6).alias("mean_confidence"),
    )


def latest_requests(log: DataFrame, limit: int = 100, time_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """K3: the newest entries."""
    return log.orderBy(F.desc(time_col), F.desc(id_col)).limit(limit)


def api_spend(calls: DataFrame, prices: DataFrame, per_hour: float = 10.0, error_rate: float = 0.05, response_time: float = 10.0) -> DataFrame:
    """Cost, error rate and latency of each hour, and whether a threshold is passed; prices are a table of fixed size.

    calls: ts, provider, text, latency, is_error; prices: provider, price (per thousand tokens), 0 for those not listed.
    """
    priced = calls.join(F.broadcast(prices), "provider", "left").withColumn("cost", estimate_cost(F.col("text"), F.coalesce("price", F.lit(0.0))))
    by = priced.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.avg(F.col("is_error").cast("int")), 9).alias("error_rate"), F.round(F.avg("latency"), 9).alias("latency")
    )
    return by.withColumn("alert", (F.col("cost") > per_hour) | (F.col("error_rate") > error_rate) | (F.col("latency") > response_time))


def monthly_spend(calls: DataFrame, prices: DataFrame, budget: float = 100.0) -> DataFrame:
    """Cost of each month, and whether it passes the budget; arguments as in ``api_spend``."""
    priced = calls.join(F.broadcast(prices), "provider", "left").withColumn("cost", estimate_cost(F.col("text"), F.coalesce("price", F.lit(0.0))))
    by = priced.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.round(F.sum("cost"), 6).alias("cost"))
    return by.withColumn("alert", F.col("cost") > budget)


def archive_totals(members: DataFrame) -> DataFrame:
    """Per archive the members, PDF members and others; members with an error count for nothing."""
    ok = members.filter("error IS NULL")
    return ok.groupBy("archive").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_pdf").alias("pdf"), F.count_if(~F.col("is_pdf")).alias("other"))
