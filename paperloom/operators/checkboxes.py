"""Checkbox states and what the forms around them say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import missing, strip_ws

# Ticked glyphs of the four glyph sets, and the items of each document kind with their names.
TICKED = {"A": ["📧", "☑", "✓", "■", "●", "◼", "◉"], "B": ["☑", "✓", "■", "●", "◼", "◉", "📧"], "C": ["✓", "☑", "■", "●", "◼", "◉"], "D": ["■", "●", "◼", "◉", "☑", "✓"]}
RIGHTS = {
    "reproduction": ["복제권", "목제권", "reproduction"],
    "performance": ["공연권", "공면권", "performance"],
    "broadcasting": ["공중송신권", "broadcasting"],
    "exhibition": ["전시권", "exhibition"],
    "distribution": ["배포권", "distribution"],
    "rental": ["대여권", "rental"],
    "derivative": ["2차적저작물작성권", "2차적저작물", "derivative"],
}
ITEMS = {
    "contract": {
        "payment_terms": {"prepaid": ["선불", "사전결제", "prepaid"], "postpaid": ["후불", "사후결제", "postpaid"], "installment": ["할부", "분할결제", "installment"]},
        "rights_granted": RIGHTS,
        "contract_type": {"exclusive": ["독점적", "exclusive"], "non_exclusive": ["비독점적", "non-exclusive"]},
        "renewal": {"auto_renewal": ["자동갱신", "auto renewal"], "manual_renewal": ["수동갱신", "manual renewal"]},
    },
    "consent": {
        "data_purposes": {"service_provision": ["서비스제공", "service provision"], "marketing": ["마케팅", "marketing"], "research": ["연구", "research"], "statistics": ["통계", "statistics"]},
        "third_party_sharing": {"allowed": ["제3자제공동의", "third party sharing"], "not_allowed": ["제3자제공거부", "no third party sharing"]},
        "marketing_consent": {"email": ["이메일마케팅", "email marketing"], "sms": ["SMS마케팅", "SMS marketing"], "phone": ["전화마케팅", "phone marketing"]},
    },
    "public_copyright_consent": {
        "work_details": {
            "stage": ["무대", "stage"],
            "lighting": ["장치", "lighting", "조명"],
            "costume": ["의상", "costume"],
            "accessories": ["장신구", "accessories"],
            "props": ["소품", "props"],
            "meditation": ["명상", "meditation"],
            "sound": ["음향", "sound"],
            "video": ["영상", "video"],
            "lighting_equipment": ["조명", "lighting equipment"],
        },
        "granted_rights": RIGHTS,
        "nuri_types": {"type_1": ["제1유형", "type 1"], "type_2": ["제2유형", "type 2"], "type_3": ["제3유형", "type 3"], "type_4": ["제4유형", "type 4"]},
    },
    "copyright_transfer": {
        "transfer_scope": {
            "reproduction": ["복제권", "reproduction"],
            "performance": ["공연권", "performance"],
            "broadcasting": ["공중송신권", "broadcasting"],
            "exhibition": ["전시권", "exhibition"],
            "distribution": ["배포권", "distribution"],
            "rental": ["대여권", "rental"],
            "derivative": ["2차적저작물작성권", "2차적저작물", "derivative"],
            "moral_rights": ["인격권", "moral rights"],
        },
        "transfer_type": {"full_transfer": ["전체양도", "full transfer"], "partial_transfer": ["부분양도", "partial transfer"], "license": ["이용허락", "license"]},
        "nuri_conditions": {"attribution": ["저작자표시", "attribution"], "commercial_use": ["상업적이용", "commercial use"], "modification": ["변경허용", "modification"], "share_alike": ["동일조건변경허락", "share alike"]},
    },
}


def checkbox_pattern(text: Column) -> Column:
    """The first glyph set of which the text has a ticked glyph, A without any.  As A holds all glyphs, always A."""
    cases = [(reduce(lambda a, b: a | b, [text.contains(g) for g in glyphs]), F.lit(name)) for name, glyphs in TICKED.items()]
    return reduce(lambda rest, case: F.when(*case).otherwise(rest), reversed(cases), F.lit("A"))


def dominant_glyph(text: Column) -> Column:
    """The ticked glyph that the text has most often, the earlier one of set A among equals; null without any."""
    counts = F.array(*[F.struct((F.length(text) - F.length(F.replace(text, F.lit(g), F.lit("")))).alias("n"), F.lit(-i).alias("order"), F.lit(g).alias("glyph")) for i, g in enumerate(TICKED["A"])])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["glyph"])


def ticked(text: Column, *names: str) -> Column:
    """Whether a ticked glyph stands before any of the names, blanks between allowed."""
    words = "|".join(n.replace("-", r"\-") for n in names)
    return text.rlike(rf"(?:{'|'.join(TICKED['A'])})\s*(?:{words})")


def after_ticks(text: Column, names: list[str]) -> Column:
    """What follows each ticked glyph and the blanks after it, as far as the longest of the names; a text is searched once."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)[{''.join(TICKED['A'])}]\s*(?=(.{{0,{max(map(len, names))}}}))"), F.lit(1))


def begins_with(found: Column, names: list[str]) -> Column:
    """Whether one of the names follows a ticked glyph, of what ``after_ticks`` found."""
    return F.exists(found, lambda x: reduce(lambda a, b: a | b, [x.startswith(n) for n in names]))


def _with_ticks(df: DataFrame, items: dict[str, list[str]], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, ticks): the generator keeps the optimizer from searching a text again for each item."""
    names = [n for own in items.values() for n in own]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.explode(F.array(after_ticks(F.col(text_col), names))).alias("ticks"))


def extract_checkboxes(df: DataFrame, kind: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, category, key, checked): every item of the kind, ticked under any of its names; null texts have none.

    A text is searched once, for its ticked glyphs; what follows each of them is then compared with the names.
    """
    after = after_ticks(F.col(text_col), [n for keys in ITEMS[kind].values() for names in keys.values() for n in names])

    def items(found: Column) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("key"), begins_with(found, names).alias("checked")) for c, keys in ITEMS[kind].items() for k, names in keys.items()])

    rows = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.flatten(F.transform(F.array(after), items))).alias("c"))
    return rows.select("doc_id", "c.*")


def checkbox_summary(df: DataFrame) -> DataFrame:
    """(doc_id, fields, n_checked, confidence): confidence counts fields, a tenth for each, up to 1."""
    name = F.concat_ws(".", "category", "key")
    return df.groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_list(name)), ",").alias("fields"), F.count_if("checked").alias("n_checked"), F.least(F.lit(1.0), F.count(F.lit(1)) / 10.0).alias("confidence")
    )


def extract_work_display(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, institution, work_names, work_category, detailed_info, n_components, components): one flag per component.

    Names after 저작물명 up to ○ are either one `institution<title>` or a list of `YYYY년 <title>`.
    """
    items = ITEMS["public_copyright_consent"]["work_details"]
    found = F.struct(strip_ws(F.regexp_extract("text", r"(?s)저작물명\s*:\s*(.*?)(?:○|\z)", 1)).alias("names"), F.struct(*[begins_with(F.col("ticks"), n).alias(key) for key, n in items.items()]).alias("components"))
    rows = _with_ticks(df, items, id_col, text_col).select("doc_id", "text", F.inline(F.array(found)))
    t, names = F.col("text"), F.col("names")
    titled = names.contains("<") & names.contains(">")
    institution = strip_ws(F.regexp_extract(names, r"([^<]+)<([^>]+)>", 1))
    title = strip_ws(F.regexp_extract(names, r"([^<]+)<([^>]+)>", 2))
    own = F.when(titled, F.array(F.concat(institution, F.lit("<"), title, F.lit(">")))).otherwise(F.regexp_extract_all(names, F.lit(r"(\d{4}년\s*<[^>]+>)"), F.lit(1)))
    return rows.select(
        "doc_id",
        F.when(titled, institution).alias("institution"),
        F.when(t.rlike(r"저작물명\s*:"), own).alias("work_names"),
        F.when(t.contains("우대미술"), F.lit("우대미술")).when(t.contains("의상") & t.contains("디자인"), F.lit("의상디자인")).alias("work_category"),
        missing(strip_ws(F.regexp_extract(t, r"(?s)상세정보\s*:\s*(.*?)(?:□|\z)", 1))).alias("detailed_info"),
        reduce(lambda a, b: a + b, [F.col("components")[key].cast("int") for key in items]).alias("n_components"),
        "components",
    )


def extract_license(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Purpose sentence and institution where they occur, one flag per right, and the fixed license type."""
    t = F.col("text")
    purpose, institution = "저작물의 개방을 통해 이용자가 자유롭게 이용할 수 있도록", "국립극장"
    return _with_ticks(df, RIGHTS, id_col, text_col).select(
        "doc_id",
        F.when(t.contains(purpose), F.lit(purpose)).alias("license_purpose"),
        F.when(t.contains(institution), F.lit(institution)).alias("licensing_institution"),
        *[begins_with(F.col("ticks"), names).alias(key) for key, names in RIGHTS.items()],
        F.lit("비독점적 이용허락").alias("license_type"),
    )


def extract_open_license(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The last ticked of the four types, the types that occur (sorted), two modification flags and the condition."""
    t = F.col(text_col)
    types = ITEMS["public_copyright_consent"]["nuri_types"]
    chosen = reduce(lambda rest, n: F.when(ticked(t, n), F.lit(n)).otherwise(rest), [n for names in types.values() for n in names], F.lit(None).cast("string"))
    purpose = "공공저작물의 자유이용 활성화"
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.when(t.contains(purpose), F.lit(purpose)).alias("license_purpose"),
        chosen.alias("nuri_type"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit("(제[1-4]유형)"), F.lit(1)))), ",").alias("available_types"),
        t.rlike("동일성유지권.*동의").alias("integrity_right_waiver"),
        t.rlike("변경.*가능").alias("modification_allowed"),
        missing(F.regexp_extract(t, "(연구.*결과.*명예.*심각한.*훼손.*특별한.*사정.*없는.*한)", 1)).alias("conditions"),
    )
