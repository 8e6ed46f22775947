"""Entity extraction by rules, validity, union with model output, and summaries of entities."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import WHITE, clean_entity, strip_ws
from ..sources.record_files import spread_files, write_files
from .entity_search import GAP, Anchor, Search, any_of, search, search_texts


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that is the value, label prefixes to take out of it, and where to look for it.

    One of ``words`` is in every match, so texts without any are not searched.  ``run`` are characters that every match begins
    with and that may go on without a limit: the search begins where such a run begins, or where the last match ended, and not
    at each of its characters.  ``anchor`` is for the search of many texts at once; a rule without one begins with a fixed word.
    """

    type: str
    pattern: str
    words: tuple[str, ...]
    drop: tuple[str, ...] = ()
    run: str = ""
    group: int = 1
    anchor: Anchor | None = None

    def search(self) -> str:
        return rf"(?:\G|(?<![{self.run}])){self.pattern}" if self.run else self.pattern


HANGUL, LOCAL = "가-힣", "a-zA-Z0-9._%+-"
ORGS = ("소속:", "회사:", "기관:")
TITLES = ("씨", "님", "선생", "교수", "박사", "의원", "대표", "이사", "부장", "과장", "대리", "주임", "팀장")
ORG_ENDS = ("주식회사", "㈜", "회사", "기관", "재단", "협회", "센터", "연구소", "연구원", "대학교", "청", "처", "부", "원")
DIGIT = "0-9"
# The patterns of each type, in order.
RULES = [
    Rule("NAME", r"([가-힣]{2,4})(?=\s*(?:씨|님|선생|교수|박사|의원|대표|이사|부장|과장|대리|주임|팀장))", ("씨", "님", "선생", "교수", "박사", "의원", "대표", "이사", "부장", "과장", "대리", "주임", "팀장"), (":",), anchor=Anchor(any_of(TITLES), HANGUL, 2, 4, spaces=True)),
    Rule("NAME", r"성명:\s*([가-힣]{2,4})", ("성명:",), (":",)),
    Rule("NAME", r"이름:\s*([가-힣]{2,4})", ("이름:",), (":",)),
    Rule("NAME", r"계약자:\s*([가-힣]{2,4})", ("계약자:",), (":",)),
    Rule("NAME", r"(?:갑|을):\s*([가-힣]{2,4})", ("갑:", "을:"), (":",)),
    Rule("PHONE", r"(\d{2,3}-\d{3,4}-\d{4})", ("-",), anchor=Anchor(r"-(?=\d{3,4}-\d{4})", DIGIT, 2, 3)),
    Rule("PHONE", r"(\d{3}-\d{4}-\d{4})", ("-",), anchor=Anchor(r"-(?=\d{4}-\d{4})", DIGIT, 3, 3)),
    Rule("PHONE", r"전화번호:\s*([0-9-]{10,15})", ("전화번호:",)),
    Rule("PHONE", r"연락처:\s*([0-9-]{10,15})", ("연락처:",)),
    Rule("PHONE", r"TEL:\s*([0-9-]{10,15})", ("TEL:",)),
    Rule("ADDRESS", r"주소:\s*([가-힣0-9\s-]+(?:시|구|군|동|로|길)[가-힣0-9\s-]*)", ("주소:",)),
    Rule("ADDRESS", r"([가-힣]+(?:시|도)\s+[가-힣]+(?:구|군)\s+[가-힣0-9\s-]*(?:로|길|동)[\s0-9]*)", ("구", "군"), run=HANGUL, anchor=Anchor(r"[시도](?=\s+[가-힣]+[구군]\s)", HANGUL)),
    Rule("ADDRESS", r"(서울시\s+[가-힣]+구[가-힣0-9\s-]*)", ("서울시",)),
    Rule("ADDRESS", r"(부산시\s+[가-힣]+구[가-힣0-9\s-]*)", ("부산시",)),
    Rule("EMAIL", r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", ("@",), run=LOCAL, anchor=Anchor("@", LOCAL)),
    Rule("COMPANY", r"([가-힣]+(?:주식회사|㈜|회사|기관|재단|협회|센터|연구소|연구원|대학교|청|처|부|원))", ("㈜", "회사", "기관", "재단", "협회", "센터", "연구소", "연구원", "대학교", "청", "처", "부", "원"), ORGS, HANGUL, anchor=Anchor(any_of(ORG_ENDS), HANGUL)),
    Rule("COMPANY", r"소속:\s*([가-힣0-9\s]+(?:주식회사|㈜|회사|기관|재단|협회|센터|연구소|연구원|대학교|청|처|부|원))", ("소속:",), ORGS),
    Rule("COMPANY", r"회사:\s*([가-힣0-9\s]+)", ("회사:",), ORGS),
    Rule("COMPANY", r"기관:\s*([가-힣0-9\s]+)", ("기관:",), ORGS),
    Rule("DATE", r"(\d{4}년\s*\d{1,2}월\s*\d{1,2}일)", ("년",), anchor=Anchor(r"년(?=\s*\d{1,2}월)", DIGIT, 4, 4)),
    Rule("DATE", r"(\d{4}\.\d{1,2}\.\d{1,2})", (".",), anchor=Anchor(r"\.(?=\d{1,2}\.\d)", DIGIT, 4, 4)),
    Rule("DATE", r"(\d{4}-\d{1,2}-\d{1,2})", ("-",), anchor=Anchor(r"-(?=\d{1,2}-\d)", DIGIT, 4, 4)),
    Rule("DATE", r"(\d{1,2}/\d{1,2}/\d{4})", ("/",), anchor=Anchor(r"/(?=\d{1,2}/\d{4})", DIGIT, 1, 2)),
    Rule("DATE", r"작성일:\s*([0-9년월일.\s-]+)", ("작성일:",)),
    Rule("DATE", r"계약일:\s*([0-9년월일.\s-]+)", ("계약일:",)),
    Rule("MONEY", r"(\d{1,3}(?:,\d{3})*원)", ("원",), ("금",), anchor=Anchor("원", "0-9,", last=True)),
    Rule("MONEY", r"금\s*(\d{1,3}(?:,\d{3})*원)", ("금",), ("금",)),
    Rule("MONEY", r"계약금:\s*([0-9,원\s]+)", ("계약금:",), ("금",)),
    Rule("MONEY", r"사업비:\s*([0-9,원\s]+)", ("사업비:",), ("금",)),
]
# Words and shapes that are no entities.
GLYPHS = ["□", "☑", "○", "●"]
BAD_ENDS = [".", ",", "·", ")", "(", ":"]
BAD_STARTS = [".", ",", "·", ")", "("]
PARTICLES = ["을", "를", "가", "는", "은", "의", "이", "에", "에서", "에게", "부터", "까지", "으로", "로", "과", "와", "및"]
NAME_VERBS = ["양도", "양수", "제공", "수령", "대표", "담당", "관리", "저작", "회사", "기관"]
NAME_ROLES = ["양도자", "양도인", "양수인", "양수자", "제공자", "이용자", "수령자", "수령인"]
NAME_EXCEPTIONS = ["김자", "이자", "박인", "한자"]
COMPANY_NOUNS = ["연락처", "주소", "성명", "전화", "휴대", "담당", "회사", "기관", "공공기관", "방송사", "관할법원", "보전처", "관할", "보전", "확인", "수행자로부", "저작인접권자로부", "저작권자로부", "권리자로부"]
SHORT_COMPANIES = ["KBS", "MBC", "SBS", "EBS"]
POSITION_WORDS = ["저작", "회사", "사업", "스튜디오", "대표", "담당", "상대방", "관계", "저작물"]
DESCRIPTION_WORDS = ["공공", "저작물", "저작권", "사회통념상", "국민들이", "영리적으로도 이용할 수", "공공저작물", "저작물을", "저작물 제작을", "저작물의"]
DESCRIPTION_ENDS = ["을", "를", "가", "는", "이", "의", "으로"]
FILE_ENDINGS = ["png", "jpg", "pdf", "txt", "doc", "xlsx", "jpeg", "gif"]
TYPE_ENDS = [" 및", " 와", " 또는"]


def _any(test, words: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [test(F.lit(w)) for w in words])


def is_valid_entity(value: Column, kind: Column) -> Column:
    """Whether a value can be an entity of its type; a null value is none, a null type has the general rules only."""
    kind = F.coalesce(kind, F.lit(""))
    n = F.length(value)
    breaks = n - F.length(F.replace(value, F.lit("\n"), F.lit("")))
    bad = (
        (n < 2)
        | (n > 50)
        | (breaks > F.when(kind == "ADDRESS", 1).otherwise(2))
        | _any(value.contains, GLYPHS)
        | value.rlike(r"^\d+\z")
        | value.rlike(r"^\d+[년월일원]\z")
        | _any(value.endswith, BAD_ENDS)
        | _any(value.startswith, BAD_STARTS)
        | value.isin(PARTICLES)
        | (strip_ws(value) == "")
    )
    name = (
        value.isin(NAME_VERBS)
        | (value.rlike(r"(자|인|처)\z") & (n <= 4) & ~value.isin(NAME_EXCEPTIONS))
        | value.isin(NAME_ROLES)
        | value.contains(".")
        | value.contains(",")
    )
    company = (
        value.isin(COMPANY_NOUNS)
        | value.contains("연락처")
        | value.contains("주소")
        | value.endswith("로부")
        | (value.contains("법원") & (n <= 6))
        | (value.endswith("처") & (n <= 3))
        | ((n < 4) & ~value.isin(SHORT_COMPANIES))
    )
    phone = value.rlike(r"^\d{4}\.\s*\d{1,2}\.\s*\d{1,2}") | (F.length(F.regexp_replace(value, r"\D", "")) < 7) | value.rlike(r"\d{2,4}\.\s*\d{4}")
    description = (
        (n < 5)
        | value.isin(DESCRIPTION_WORDS)
        | (value.contains("공공저작물") & value.contains("목적으로"))
        | _any(value.endswith, DESCRIPTION_ENDS)
        | value.contains(". ")
        | value.contains(" .")
    )
    by_type = (
        F.when(kind == "NAME", name)
        .when(kind == "COMPANY", company)
        .when(kind == "PHONE", phone)
        .when(kind == "POSITION", value.isin(POSITION_WORDS))
        .when(kind == "DESCRIPTION", description)
        .when(kind == "DATE", F.lower(value).isin(FILE_ENDINGS))
        .when(kind.isin("CONSENT_TYPE", "CONTRACT_TYPE"), (n < 3) | _any(value.endswith, TYPE_ENDS))
        .otherwise(F.lit(False))
    )
    return F.coalesce(~(bad | by_type), F.lit(False))


def _shape(kind: Column, value: Column) -> Column:
    """The length and form that a type asks of what its patterns find."""
    n = F.length(value)
    return (
        F.when(kind == "NAME", (n >= 2) & value.rlike(r"^[가-힣A-Za-z]+\z"))
        .when(kind == "PHONE", value.rlike(r"^[0-9-]{10,15}\z"))
        .when(kind == "ADDRESS", n > 5)
        .when(kind == "COMPANY", n > 2)
        .when(kind == "DATE", n > 4)
        .when(kind == "MONEY", value.contains("원") & (n > 2))
        .otherwise(F.lit(True))
    )


def value_test(kind: str) -> Callable[[str], bool]:
    """For a plain value of a type what ``_shape`` and ``is_valid_entity`` say of a column; e-mails and sums have their form alone."""
    number, letters, digits = re.compile(r"\d+[년월일원]?\Z", re.ASCII), re.compile(r"[가-힣A-Za-z]+\Z"), re.compile(r"[0-9-]{10,15}\Z")
    glyphs, ends, starts, particles, breaks = set(GLYPHS), tuple(BAD_ENDS), tuple(BAD_STARTS), set(PARTICLES), 1 if kind == "ADDRESS" else 2
    verbs, exceptions, nouns = {*NAME_VERBS, *NAME_ROLES}, set(NAME_EXCEPTIONS), set(COMPANY_NOUNS)

    def general(v: str) -> bool:
        if not 2 <= len(v) <= 50 or v.endswith(ends) or v.startswith(starts) or v in particles or number.match(v):
            return False
        return v.count("\n") <= breaks and glyphs.isdisjoint(v) and v.strip(WHITE) != ""

    def company(v: str) -> bool:
        if len(v) < 4 and v not in SHORT_COMPANIES or v in nouns or "연락처" in v or "주소" in v or v.endswith("로부"):
            return False
        return not ("법원" in v and len(v) <= 6) and not (v.endswith("처") and len(v) <= 3)

    tests = {
        "NAME": lambda v: len(v) >= 2 and letters.match(v) is not None and general(v) and v not in verbs and not (v.endswith(("자", "인", "처")) and len(v) <= 4 and v not in exceptions),
        "PHONE": lambda v: digits.match(v) is not None and general(v) and len(v) - v.count("-") >= 7,
        "ADDRESS": lambda v: len(v) > 5 and general(v),
        "COMPANY": lambda v: len(v) > 2 and company(v) and general(v),
        "DATE": lambda v: len(v) > 4 and general(v) and v.lower() not in FILE_ENDINGS,
        "MONEY": lambda v: "원" in v and len(v) > 2,
        "EMAIL": lambda v: True,
    }
    return tests[kind]


@cache
def rule_searches() -> list[tuple[str, list[Search], Callable[[str], str | None]]]:
    """``RULES`` for ``search_texts``: rules of a type with the same label prefixes share what makes their values."""

    def value(kind: str, drop: tuple[str, ...]) -> Callable[[str], str | None]:
        holds = value_test(kind)

        def tidy(v: str) -> str | None:
            for word in drop:
                v = v.replace(word, "")
            v = v.strip(WHITE)
            return v if holds(v) else None

        return tidy

    by_value: dict[tuple[str, tuple[str, ...]], list[Search]] = {}
    for r in RULES:
        by_value.setdefault((r.type, r.drop), []).append(search(r.pattern, r.anchor, r.group))
    return [(kind, searches, value(kind, drop)) for (kind, drop), searches in by_value.items()]


@F.arrow_udf(StringType())
def rule_entities(text: pa.Array) -> pa.Array:
    """What ``RULES`` find in each text, as ``search_texts`` gives it."""
    return search_texts(text.to_pylist(), rule_searches())


def extract_entities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, copies: str | None = None) -> DataFrame:
    """(doc_id, value, type), distinct within a document; null and empty texts have none.

    ``copies`` is a column that has, for each row, how many rows of the table have its identifier, where that is known: the entities
    of a text are distinct, so those of the only row of a document are not sent to be compared.

    ``RULES`` pass over a batch of texts at once.  Patterns of other rules run in one projection over the text, which is exploded
    once and does not enter the shuffle; a pattern runs only over texts that hold one of its words, and over each run of
    characters once.  Values are tested before they become rows, each by the tests of its own type alone.
    """
    text = F.col(text_col)
    if rules is RULES:
        # what is no UTF-8 is replaced, as patterns of columns do it
        found = df.filter(text.isNotNull()).select(F.col(id_col).alias("doc_id"), *([copies] if copies else []), rule_entities(F.make_valid_utf8(text)).alias("found"))
        # outer, as the optimizer would search a second time to ask whether there is anything to explode
        each = lambda rows: rows.select("doc_id", F.explode_outer(F.split("found", GAP)).alias("e")).filter("e IS NOT NULL")
        # few bytes are sent for a document, to a given number of partitions, as adaptive execution would count these bytes and not the
        # rows that come of them
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        once = F.col(copies).eqNullSafe(1) if copies else F.lit(False)
        out = each(found.filter(~once).repartition(parts, "doc_id")).distinct()
        out = each(found.filter(once)).unionAll(out) if copies else out
        return out.select("doc_id", F.expr("substr(e, instr(e, ' ') + 1)").alias("value"), F.substring_index("e", " ", 1).alias("type"))
    none = F.array().cast("array<string>")

    def found(rule: Rule) -> Column:
        def tidy(v: Column) -> Column:
            for word in rule.drop:
                v = F.replace(v, F.lit(word), F.lit(""))
            return strip_ws(v)

        return F.when(_any(text.contains, rule.words), F.transform(F.regexp_extract_all(text, F.lit(rule.search()), F.lit(rule.group)), tidy)).otherwise(none)

    def of_type(name: str) -> Column:
        kind = F.lit(name)
        values = F.array_distinct(F.concat(*[found(r) for r in rules if r.type == name]))
        keep = lambda v: _shape(kind, v) if name in ("EMAIL", "MONEY") else _shape(kind, v) & is_valid_entity(v, kind)
        return F.transform(F.filter(values, keep), lambda v: F.struct(v.alias("value"), kind.alias("type")))

    every = F.concat(*[of_type(name) for name in dict.fromkeys(r.type for r in rules)])
    return df.filter(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(every).alias("e")).select("doc_id", "e.value", "e.type").distinct()


def confidence_filter(tokens: DataFrame, token_min: float = 0.7) -> DataFrame:
    """Labels of tokens below the bound become O."""
    return tokens.withColumn("label", F.when(F.col("confidence") < token_min, F.lit("O")).otherwise(F.col("label")))


def filter_entities(df: DataFrame, types: list[str] | None = None, min_confidence: float = 0.85) -> DataFrame:
    """P10: entities of the types with the confidence; those without one (rules) pass."""
    out = df if types is None else df.filter(F.col("type").isin(types))
    return out.filter(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))


def merge_entities(model: DataFrame, rule: DataFrame) -> DataFrame:
    """Per document one row per value (case and outer blanks apart): model before rule, then type, then value."""
    return merge_ranked(model.select("doc_id", "value", "type", F.lit(0).alias("rank")).unionByName(rule.select("doc_id", "value", "type", F.lit(1).alias("rank"))))


def merge_ranked(both: DataFrame) -> DataFrame:
    """J1 over rows (doc_id, value, type, rank) of both sources, rank 0 those of the model."""
    key = F.lower(strip_ws(F.col("value")))
    best = both.withColumn("place", F.row_number().over(W.partitionBy("doc_id", key).orderBy("rank", "type", "value"))).filter("place = 1")
    return best.select("doc_id", "value", "type", F.when(F.col("rank") == 0, F.lit("model")).otherwise(F.lit("rule")).alias("source"))


def clean_values(df: DataFrame) -> DataFrame:
    """T10 on the value column; what is empty then goes."""
    return df.withColumn("value", clean_entity(F.col("value"))).filter("value <> ''")


def group_entities_by_type(df: DataFrame) -> DataFrame:
    """A1: (doc_id, entities map<type, sorted values>, entity_count, entity_types)."""
    by_type = df.groupBy("doc_id", "type").agg(F.sort_array(F.collect_list("value")).alias("values"))
    out = by_type.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("type", "values"))).alias("e"))
    return out.select("doc_id", F.map_from_entries("e").alias("entities"), F.aggregate("e", F.lit(0), lambda a, x: a + F.size(x["values"])).alias("entity_count"), F.size("e").alias("entity_types"))


def corpus_entity_summary(df: DataFrame) -> DataFrame:
    """A2: one row for each type and a total (type null): documents, mentions, distinct values."""
    return df.rollup("type").agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("mentions"), F.countDistinct("value").alias("distinct_values"))


def merge_document_entities(df: DataFrame) -> DataFrame:
    """A3: (type, value, documents): the distinct values of each type over all documents."""
    return df.groupBy("type", "value").agg(F.countDistinct("doc_id").alias("documents"))


def sort_entities(df: DataFrame) -> DataFrame:
    """K1."""
    return df.orderBy("type", "value", "doc_id")


def entity_files(df: DataFrame, paths: DataFrame, root: str = "") -> DataFrame:
    """(name, content): for each document with entities one JSON object under its path below ``root``, ``stem_entities.json``.

    ``paths`` has (doc_id, path).
    """
    path = F.regexp_replace("path", "^(?:file:/*(?=/))?" + re.escape(root.rstrip("/")) + "/*", "") if root else F.col("path")
    rows = group_entities_by_type(df).filter("entity_count > 0").join(paths.select("doc_id", "path"), "doc_id")
    content = F.to_json(F.struct(F.col("path").alias("file"), "entities", "entity_count", F.map_keys("entities").alias("entity_types")))
    return spread_files(rows.select(F.concat(F.regexp_replace(path, r"\.[^./]*\z", ""), F.lit("_entities.json")).alias("name"), content.alias("content")))


def write_entity_results(df: DataFrame, paths: DataFrame, out: str, root: str = "", job: str | None = None) -> None:
    """The files of ``entity_files``, all of them or none."""
    write_files(entity_files(df, paths, root), out, job)
