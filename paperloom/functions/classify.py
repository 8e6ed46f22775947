"""Document classes from text, file names and paths, as ordered CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTRACT, CONSENT = "계약서", "동의서"

TRANSFER, PUBLIC, OTHER = "저작재산권 양도동의서", "공공저작물 자유이용허락 동의서", "기타문서"

# Rules in order, (class, words any of which decides).
BY_NAME = [(CONTRACT, ["계약서", "contract"]), (CONSENT, ["동의서", "consent"]), (TRANSFER, ["양도", "transfer"]), (PUBLIC, ["공공", "public"])]
BY_CONTENT = [(CONTRACT, ["계약서", "계약", "contract"]), (CONSENT, ["동의서", "동의", "consent"]), (TRANSFER, ["양도", "transfer"]), (PUBLIC, ["공공저작물", "공공", "public"])]
BY_TITLE = [(TRANSFER, ["양도동의서", "copyright transfer", "transfer consent"]), (PUBLIC, ["공공저작물 자유이용허락 동의서", "공공누리", "public copyright"]), (CONTRACT, ["계약서", "contract", "agreement"]), (CONSENT, ["동의서", "consent"])]
SCHEMAS = [
    ("copyright_transfer", ["양도동의", "copyright transfer", "transfer consent"]),
    ("public_copyright", ["공공저작물", "공공누리", "자유이용허락", "public copyright"]),
    ("contract_enhanced", ["계약서", "contract"]),
    ("consent_enhanced", ["동의서", "consent"]),
]
PATH_WORDS = [(CONTRACT, ["계약서", "contract"]), (CONSENT, ["동의서", "consent"])]
STEM_WORDS = [(CONTRACT, ["계약", "contract", "agreement"]), (CONSENT, ["동의", "consent", "approval"])]
FILE_WORDS = [("contract", ["계약서", "contract", "agreement"]), ("consent", ["동의서", "consent"]), ("copyright", ["저작권", "copyright", "양도"])]
ANCHORS = ["data", "documents", "files", "images"]


def by_words(text: Column, rules: list[tuple[str, list[str]]], default: Column, lower: bool = True) -> Column:
    """The class of the first rule one of whose words the text has, in lower case unless said otherwise."""
    low = F.lower(text) if lower else text
    cases = [(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(name)) for name, words in rules]
    return reduce(lambda rest, case: F.when(*case).otherwise(rest), reversed(cases), default)


def detect_doc_type(text: Column, forced: str | None = None) -> Column:
    """Contract or consent; a forced type wins."""
    if forced in ("contract", CONTRACT):
        return F.lit(CONTRACT)
    if forced in ("consent", CONSENT):
        return F.lit(CONSENT)
    head = F.substring(text, 1, 400)
    return (
        F.when(head.contains("동의서") | text.contains("개인정보 수집") | text.contains("동의 철회"), F.lit(CONSENT))
        .when(head.contains("계약서") | text.rlike(r"(?m)^제\d+조\("), F.lit(CONTRACT))
        .when(text.contains("갑") & text.contains("을"), F.lit(CONTRACT))
        .otherwise(F.lit(CONSENT))
    )


def detect_document_type(filename: Column, content: Column) -> Column:
    """By the words of the file name, then by those of the content, else 기타문서."""
    return by_words(filename, BY_NAME, by_words(content, BY_CONTENT, F.lit(OTHER)))


def document_type_from_title(title: Column) -> Column:
    """Specific kinds before generic ones; the words count as they are written, so English ones in lower case only."""
    return by_words(title, BY_TITLE, F.lit(OTHER), lower=False)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*\z", "")


def category_from_path(path: Column) -> Column:
    """By a word anywhere in the path, then by a word of the stem, else a consent."""
    return by_words(path, PATH_WORDS, by_words(stem(path), STEM_WORDS, F.lit(CONSENT)))


def category_from_filename(name: Column) -> Column:
    """P5."""
    return by_words(name, FILE_WORDS, F.lit("general"))


def category_from_anchor(path: Column) -> Column:
    """The path segment after the first anchor folder, null without one."""
    parts = F.split(path, "/")
    at = F.array_min(F.filter(F.transform(F.array(*[F.lit(a) for a in ANCHORS]), lambda a: F.array_position(parts, a)), lambda p: p > 0))
    return F.try_element_at(parts, (at + 1).cast("int"))


def schema_for_document_type(kind: Column) -> Column:
    """The schema of a document type, specific ones first; plain documents have the extended schemas."""
    return by_words(kind, SCHEMAS, F.lit("general_enhanced"))
