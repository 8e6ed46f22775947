"""Labelled corpora from a grammar: sentences with slots of 23 types, several of one type too, and values put together by hash picks."""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .synth import CONNECTORS, SCANNED, _once, pick, pool_value

# Our own words.  A pattern of VALUES names a list by <name>, or a number by <least-most>, padded where it begins with 0.
PARTS = {
    "family": ["김", "이", "박", "최", "정", "강", "조", "윤", "장", "임", "한", "오"],
    "given": ["하늘", "바다", "구름", "나무", "가람", "이슬", "보람", "새봄", "한결", "다온", "슬기", "누리"],
    "brand": ["가온", "누리", "다솜", "라온", "마루", "바름", "새길", "아람", "자운", "한빛"],
    "house": ["출판사", "연구소", "재단", "방송", "협회", "기획", "문화원", "박물관"],
    "city": ["서울시", "부산시", "대구시", "인천시", "광주시", "대전시"],
    "ward": ["중구", "동구", "서구", "남구", "북구"],
    "road": ["새길", "바닷길", "언덕길", "은행나무길", "솔밭길", "강변길"],
    "area": ["02", "031", "032", "051", "053"],
    "user": ["info", "desk", "press", "office", "archive"],
    "host": ["example.com", "example.org", "example.net"],
    "rank": ["과장", "대리", "부장", "주임", "이사", "대표", "연구원"],
    "right": ["복제권", "공연권", "전시권", "배포권", "대여권", "공중송신권"],
    "field": ["총무", "기획", "홍보", "편집", "자료", "저작권"],
    "topic": ["기록", "지도", "악보", "사진", "구술", "향토", "설화", "민요"],
    "form": ["자료집", "모음", "총서", "연감", "도록"],
    "law": ["저작권법", "민법", "개인정보 보호법", "전자서명법"],
    "state": ["완료", "진행 중", "대기", "보류", "반려"],
    "tongue": ["한국어", "영어", "중국어", "일본어", "프랑스어"],
    "kind": ["어문", "음악", "미술", "사진", "영상", "건축"],
    "deal": ["양도", "이용 허락", "위탁", "공동 제작", "출판"],
    "consent": ["개인정보 수집", "저작물 이용", "초상 이용", "제3자 제공"],
    "unit": ["부", "건", "점", "권", "매"],
}
VALUES = {
    "NAME": ["<family><given>"],
    "PHONE": ["010-<1000-9999>-<1000-9999>", "<area>-<100-999>-<1000-9999>"],
    "ADDRESS": ["<city> <ward> <road> <1-999>", "<city> <ward> <road> <1-99>-<1-30>"],
    "DATE": ["<2015-2025>년 <1-12>월 <1-28>일", "<2015-2025>.<01-12>.<01-28>", "<2015-2025>-<01-12>-<01-28>"],
    "COMPANY": ["<brand><house>", "주식회사 <brand><field>", "<brand> <topic> <house>"],
    "EMAIL": ["<user><1-9999>@<host>"],
    "POSITION": ["<rank>", "<field> <rank>"],
    "CONTRACT_TYPE": ["저작재산권 <deal> 계약서", "<kind> 저작물 <deal> 계약서"],
    "CONSENT_TYPE": ["<consent> 동의서"],
    "RIGHT_INFO": ["<right>", "<right> 및 2차적저작물작성권"],
    "MONEY": ["<1-999>,000원", "금 <1-99>,<100-999>,000원", "<10-900>만원"],
    "PERIOD": ["<1-30>년간", "<2015-2020>.<01-12>.<01-28>부터 <2021-2035>.<01-12>.<01-28>까지", "계약일부터 <3-60>개월"],
    "PROJECT_NAME": ["<2015-2025>년 <topic> <form> 사업", "<brand> <topic> 조사 사업"],
    "LAW_REFERENCE": ["<law> 제<1-140>조", "<law> 제<1-140>조 제<1-9>항"],
    "ID_NUM": ["<50-99><01-12><01-28>-<1-2>******"],
    "TITLE": ["<topic> <form> 제<1-90>호", "<city> <topic> <form>"],
    "URL": ["https://www.<user><1-999>.example.org/<topic>/<1-9999>"],
    "DESCRIPTION": ["<city>의 <topic>을 담은 <form>", "<1-90>쪽의 <kind> 저작물"],
    "TYPE": ["<kind>저작물"],
    "STATUS": ["<state>"],
    "DEPARTMENT": ["<field>팀", "<topic> <field>부"],
    "LANGUAGE": ["<tongue>"],
    "QUANTITY": ["<1-900><unit>"],
}
SENTENCES = [
    "{COMPANY} {DEPARTMENT} {POSITION} {NAME}의 연락처는 {PHONE}입니다.",
    "양도인 {NAME}, 양수인 {NAME}은 {DATE}에 {CONTRACT_TYPE}를 맺는다.",
    "주소 {ADDRESS}, 담당 {NAME}, 전화 {PHONE}, 전자우편 {EMAIL}",
    "{COMPANY}은 {DATE}까지 {MONEY}, {DATE}까지 {MONEY}을 지급한다.",
    "저작물 {TITLE} ({TYPE}, {LANGUAGE}, {QUANTITY}): {DESCRIPTION}",
    "{PROJECT_NAME}에 따라 {RIGHT_INFO}, {RIGHT_INFO}을 {PERIOD} 허락한다.",
    "근거는 {LAW_REFERENCE}와 {LAW_REFERENCE}이다.",
    "{CONSENT_TYPE} 작성자 {NAME} ({ID_NUM}), 처리 상태 {STATUS}",
    "공개 주소 {URL}, 문의 {EMAIL}, 관리 {DEPARTMENT}",
    "{COMPANY}, {COMPANY}, {COMPANY}이 {PROJECT_NAME}을 함께 한다.",
    "성명 {NAME}\n생년월일 {ID_NUM}\n주소 {ADDRESS}\n날짜 {DATE}",
    "{TITLE} {QUANTITY}, {TITLE} {QUANTITY} 납품, 대금 {MONEY}",
]


def segments(sentence: str) -> list[str]:
    """The stretches of a sentence in order; a slot keeps its braces."""
    return [s for s in re.split(r"(\{[A-Z_]+\})", sentence) if s]


def pieces(pattern: str) -> list[str | list[str] | tuple[int, int, int]]:
    """What a pattern puts together: texts, lists of words, and numbers as (least, most, width)."""

    def piece(inner: str):
        if inner in PARTS:
            return PARTS[inner]
        low, high = inner.split("-")
        return int(low), int(high), len(low) if low[0] == "0" else 0

    return [piece(s) if k % 2 else s for k, s in enumerate(re.split(r"<([^>]+)>", pattern)) if s]


def _table(of: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """The lists one after the other, where each begins, and its length."""
    sizes = np.array([len(x) for x in of])
    return [v for x in of for v in x], sizes.cumsum() - sizes, sizes


def _words(p) -> list[str]:
    if isinstance(p, tuple):
        return [str(i).rjust(p[2], "0") for i in range(p[0], p[1] + 1)]
    return [p] if isinstance(p, str) else p


# Types have forms, forms have pieces, a piece is one of its words; numbers are words too.
_FORMS, FORM, N_FORMS = _table([[pieces(q) for q in patterns] for patterns in VALUES.values()])
_PIECES, PIECE, N_PIECES = _table([list(enumerate(form)) for form in _FORMS])
_ALL, WORD, N_WORDS = _table([_words(p) for _, p in _PIECES])
WORDS, PLACES, KINDS = pa.array(_ALL), pa.array([str(n) for n, _ in _PIECES]), pa.array(list(VALUES))
SLOTS, TAGS = pa.array(["{" + k + "}" for k in VALUES]), pa.array(["O", *[f"{head}-{k}" for k in VALUES for head in "BI"]])
ENTITY = StructType([StructField("value", StringType()), StructField("type", StringType()), StructField("start", IntegerType())])
FILLED = StructType([StructField("text", StringType()), StructField("entities", ArrayType(ENTITY)), StructField("labels", ArrayType(StringType()))])


def _picked(n: np.ndarray, name: pa.Array, what: pa.Array | str) -> np.ndarray:
    """``pick`` for many names at once."""
    names = pc.binary_join_element_wise(name, what, "/").cast(pa.binary()).to_pylist()
    return np.frombuffer(b"".join([md5(x, usedforsecurity=False).digest()[:4] for x in names]), ">u4").astype(np.int64) % n


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()), pa.int32()), values)


def _within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every item of lists of these sizes: its list, and its place there."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    return own, np.arange(len(own)) - (sizes.cumsum() - sizes)[own]


@F.arrow_udf(FILLED)
def fill_slots(key: pa.Array, slots: pa.Array) -> pa.Array:
    """Text, entities and labels of texts by their slots; ``key`` is seed and id, what begins with { is a type to fill in."""
    sizes = slots.value_lengths().to_numpy(zero_copy_only=False)
    row, place = _within(sizes)
    flat = slots.flatten()
    kind = pc.fill_null(pc.index_in(flat, SLOTS), -1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(kind >= 0)
    kinds = kind[own]
    name = pc.binary_join_element_wise(key.take(pa.array(row[own])), pa.array(place[own]).cast(pa.string()), "/")

    form, many = FORM[kinds], np.flatnonzero(N_FORMS[kinds] > 1)
    form[many] += _picked(N_FORMS[kinds[many]], name.take(pa.array(many)), "form")
    slot, nth = _within(N_PIECES[form])
    piece = PIECE[form][slot] + nth
    word, many = WORD[piece], np.flatnonzero(N_WORDS[piece] > 1)
    word[many] += _picked(N_WORDS[piece[many]], name.take(pa.array(slot[many])), PLACES.take(pa.array(piece[many])))
    made = pc.binary_join(_lists(N_PIECES[form], WORDS.take(pa.array(word))), "")
    values = pc.replace_with_mask(flat, pa.array(kind >= 0), made)
    texts = pc.binary_join(_lists(sizes, values), "")

    length = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = length.cumsum() - length
    tag = np.repeat(2 * kind + 2, length)  # I of the type, 0 is O
    tag[begin[own]] -= 1
    tag[np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4") == ord(" ")] = 0
    start = (begin - (chars.cumsum() - chars)[row])[own]
    entity = pa.StructArray.from_arrays([made, KINDS.take(pa.array(kinds)), pa.array(start, pa.int32())], ENTITY.names)
    entities = _lists(np.bincount(row[own], minlength=len(sizes)), entity)
    return pa.StructArray.from_arrays([texts, entities, _lists(chars, TAGS.take(pa.array(tag)))], FILLED.names)


def synthesize_varied_corpus(ids: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """G1 by a grammar: (id, text, entities, labels), a function of seed and id alone.

    ``entities`` holds value, type and start (from 0) in the order of the text; ``labels`` has one tag per character, B and I of
    the slot that wrote it, O elsewhere and on spaces.  Two in five texts join two to four sentences, three in five get one
    to eight values more, one in five ends in a line as scanners leave it.  Texts with fewer than three entities or two
    types are dropped.  Identifiers that repeat give the same text; rows without an identifier are dropped.
    """
    key, none = F.col("id"), F.array().cast("array<string>")
    sentences = F.array(*[F.array(*[F.lit(s) for s in segments(t)]) for t in SENTENCES])
    slots = ["{" + k + "}" for k in VALUES]

    def sentence(j: Column) -> Column:
        return F.concat(F.when(j > 0, F.array(F.lit("\n"))).otherwise(none), F.get(sentences, pick(len(SENTENCES), seed, key, "sentence", j)))

    def extra(j: Column) -> Column:
        return F.array(pool_value(CONNECTORS, pick(len(CONNECTORS), seed, key, "link", j)), pool_value(slots, pick(len(slots), seed, key, "type", j)))

    n_sentences = F.when(pick(100, seed, key, "many") < 40, pick(3, seed, key, "sentences") + 2).otherwise(1)
    n_extra = F.when(pick(100, seed, key, "more") < 60, pick(8, seed, key, "extras") + 1).otherwise(0)
    scanned = F.when(pick(100, seed, key, "scan") < 20, F.array(pool_value(SCANNED, pick(len(SCANNED), seed, key, "scanned")))).otherwise(none)
    rows = _once(ids.select(F.col(id_col).alias("id")).filter("id IS NOT NULL"), n_sentences.alias("n"), n_extra.alias("m"))
    first = F.flatten(F.transform(F.sequence(F.lit(0), F.col("n") - 1), sentence))
    more = F.when(F.col("m") > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.greatest("m", F.lit(1))), extra))).otherwise(none)
    rows = _once(rows, F.concat(first, more, scanned).alias("slots"))
    rows = rows.filter((F.size(F.filter("slots", lambda s: s.startswith("{"))) >= 3) & (F.size(F.array_distinct(F.filter("slots", lambda s: s.startswith("{")))) >= 2))
    # values and labels are made in one pass over the slots: a lambda for each character and pick was most of the work
    return rows.select("id", fill_slots(F.concat_ws("/", F.lit(str(seed)), key.cast("string")), "slots").alias("made")).select("id", "made.*")
