"""Text functions: masking, normalisation, field shapes, cleaning of model output.  All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes of the fields.
RESIDENT_ID = r"\d{6}-\d{7}"
RESIDENT_MASK = "******-*******"
DATE_TRIPLE = r"(20\d{2})[.\-/년]\s*(\d{1,2})[.\-/월]\s*(\d{1,2})"
AMOUNT = r"([₩]?\s*[\d,]+)\s*원"
PHONE = r"(\d{2,3}-\d{3,4}-\d{4})"
BUSINESS_NO = r"(\d{3}-\d{2}-\d{5})"
SECTION_MARKS = {
    "contract": ["제1조", "제2조", "제3조", "제4조", "제5조"],
    "copyright_transfer": ["제1조", "제2조", "제3조"],
    "consent": ["○", "동의함", "동의하지 않음"],
    "public_copyright": ["□ 저작물 표시", "□ 저작물 이용허락", "□ 공공누리"],
}
WHITE = " \n\t\r\x0b\f"


def strip_ws(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def missing(text: Column) -> Column:
    """The empty string as null."""
    return F.nullif(text, F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return missing(F.regexp_extract(text, pattern, group))


def pack_sentences(text: Column, max_len: int = 512) -> Column:
    """Array of packed sentences; a text of at most ``max_len`` characters is one element as it is.

    Line ends become ". ", sentences end at ".", are trimmed, and are packed greedily while they fit.
    """
    parts = F.filter(F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(". ")), r"\."), strip_ws), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(s) <= max_len
        done = F.when(fits | (acc["cur"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], strip_ws(acc["cur"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(acc["cur"], s, F.lit(". "))).otherwise(F.concat(s, F.lit(". "))).alias("cur"))

    packed = F.aggregate(parts, start, add, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], strip_ws(acc["cur"]))))
    return F.when(F.length(text) <= max_len, F.array(text)).otherwise(packed)


def collapse_whitespace(text: Column) -> Column:
    """Any run of white space is one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def mark_sections(text: Column, kind: str) -> Column:
    """White space collapsed, then a line end before each section marker of the kind."""
    out = collapse_whitespace(text)
    for mark in SECTION_MARKS.get(kind, []):
        out = F.replace(out, F.lit(mark), F.lit("\n" + mark))
    return out


def mask_resident_id(text: Column) -> Column:
    """T4."""
    return F.regexp_replace(text, RESIDENT_ID, RESIDENT_MASK)


def checksum(text: Column) -> Column:
    """T5: SHA-256 of the (masked) text."""
    return F.sha2(text, 256)


def identifier(text: Column) -> Column:
    return F.substring(checksum(text), 1, 16)


def iso_dates(text: Column) -> Column:
    """All dates of a text as YYYY-MM-DD, in order; not checked against the calendar."""
    part = lambda d, g: F.regexp_extract(d, DATE_TRIPLE, g)
    # the text is searched once, for whole dates, and each of them then taken apart
    return F.transform(F.regexp_extract_all(text, F.lit(DATE_TRIPLE), F.lit(0)), lambda d: F.concat_ws("-", part(d, 1), F.lpad(part(d, 2), 2, "0"), F.lpad(part(d, 3), 2, "0")))


def extract_date_range(text: Column) -> Column:
    """Struct of the first and the last date; one date is both, none gives nulls."""
    ends = lambda dates: F.struct(F.try_element_at(dates, F.lit(1)).alias("effective_date"), F.try_element_at(dates, F.lit(-1)).alias("expiry_date"))
    return F.get(F.transform(F.array(iso_dates(text)), ends), 0)  # both of one search


def extract_amount(text: Column) -> Column:
    """The first amount in won as a number."""
    return F.regexp_replace(first_group(text, AMOUNT), r"[^\d]", "").try_cast("bigint")


def extract_phone(text: Column) -> Column:
    """T8."""
    return first_group(text, PHONE)


def extract_business_no(text: Column) -> Column:
    return first_group(text, BUSINESS_NO)


def has_signature(text: Column, kind: str = "contract") -> Column:
    """The words for signature or seal; for consents also the one for a signature field."""
    return text.rlike("서명|날인" if kind == "contract" else "서명|날인|서명란")


def clean_entity(value: Column) -> Column:
    """Without leading and trailing runs of colons, commas, dots, hyphens and white space."""
    return F.regexp_replace(F.regexp_replace(strip_ws(value), r"^[:\s,.\-]+", ""), r"[:\s,.\-]+\z", "")


def strip_markdown(text: Column) -> Column:
    """Code fences, bold, italic and inline code lose their marks; at most one empty line in a row."""
    out = F.regexp_replace(text, r"```[a-zA-Z]*\n?", "")
    for pattern in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
        out = F.regexp_replace(out, pattern, "$1")
    return strip_ws(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def json_slice(response: Column) -> Column:
    """The text from the first { to the last }, of a fenced JSON block if there is one; null without braces."""

    def cut(own: Column) -> Column:
        first = F.instr(own, "{")
        last = F.length(own) - F.instr(F.reverse(own), "}") + 1
        return F.when((first > 0) & (F.instr(own, "}") > 0) & (last >= first), F.substring(own, first, last - first + 1))

    return _once(_once(response, lambda r: F.coalesce(first_group(r, r"(?s)```json\s*(.*?)```"), r)), cut)


def parse_model_json(response: Column) -> Column:
    """The slice where it parses as JSON, else an empty object."""
    return _once(json_slice(response), lambda cut: F.when(F.try_parse_json(cut).isNotNull(), cut).otherwise(F.lit("{}")))


def coerce_payment_amount(value: Column) -> Column:
    """The first run of digits as a number ("1,000" gives 1), else null."""
    return first_group(value, r"(\d+)").try_cast("bigint")


def normalize_consent_status(value: Column) -> Column:
    """T14."""
    return (
        F.when(value.isNull() | (value == ""), value)
        .when(value.contains("동의함") | value.contains("✓"), F.lit("동의함"))
        .when(value.contains("동의하지 않음") | value.contains("✗"), F.lit("동의하지 않음"))
        .otherwise(F.lit("null"))
    )


def trim_record_fields(
    df: DataFrame,
    columns: tuple[str, ...] = ("rights_holder", "user", "work_title", "data_controller", "work_info.work_title"),
    arrays: tuple[str, ...] = ("work_names", "work_display.work_names"),
) -> DataFrame:
    """The named string fields trimmed, and every element of the named arrays; absent ones are left out, a.b is field b of a."""
    kinds = {f.name: f.dataType for f in df.schema}
    for name in (*columns, *arrays):
        top, _, inner = name.partition(".")
        tidy = (lambda c: F.transform(c, strip_ws)) if name in arrays else strip_ws
        if top in kinds and not inner:
            df = df.withColumn(top, tidy(F.col(top)))
        elif top in kinds and inner in getattr(kinds[top], "names", ()):
            df = df.withColumn(top, F.when(F.col(top).isNotNull(), F.col(top).withField(inner, tidy(F.col(top)[inner]))))
    return df


def field_completeness(fields: list[Column], properties: int | None = None) -> Column:
    """Filled fields / properties of the schema, at most 1; without properties 1."""
    properties = len(fields) if properties is None else properties
    if not properties:
        return F.lit(1.0)
    filled = sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in fields), F.lit(0))
    return F.least(F.lit(1.0), filled / F.lit(float(properties)))


def estimate_cost(text: Column, price: Column) -> Column:
    """A quarter token for each character, priced per thousand tokens."""
    return F.length(text) / 4 * price / 1000


def safe_model_name(name: Column) -> Column:
    """Slashes become hyphens."""
    return F.replace(name, F.lit("/"), F.lit("-"))


def safe_file_name(name: Column) -> Column:
    """Trimmed, spaces as underscores, then word characters, hyphens and dots only."""
    return F.regexp_replace(F.regexp_replace(strip_ws(name), " ", "_"), r"(?U)[^\w\-.]", "")


def build_prompt(text: Column, schema_json: str, doc_type: Column) -> Column:
    """Our own instruction around document type, schema and text."""
    return F.concat(F.lit("Read the document below, which is a "), doc_type, F.lit(".\nAnswer with one JSON object for this schema and with nothing else:\n" + schema_json + "\n---\n"), text, F.lit("\n---\n"))
