"""Labelled corpora made from templates by hash picks: the same for a seed, however the work is partitioned."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import extract_fields_best
from .sequence import tag_characters

# Our own templates, value pools and additions; a template has each slot once at most.
TEMPLATES = [
    "{COMPANY} 소속 {NAME} {POSITION}의 연락처는 {PHONE}입니다.",
    "{DATE}에 {NAME}은 {COMPANY}와 {MONEY} 계약을 맺었다.",
    "주소 {ADDRESS}, 담당 {NAME}, 전화 {PHONE}",
    "{COMPANY}은 {DATE}까지 {MONEY}을 {NAME}에게 지급한다.",
    "작성 {DATE}, 확인 {NAME}",
]
CONNECTORS = [" 그리고 ", " 덧붙여 ", " 참고로 "]
SCANNED = ["\n□ 확인함 □ 확인하지 않음", "\n(인)", "\n서명란 ________"]
POOLS = {
    "NAME": ["김하늘", "이바다", "박구름", "최나무", "정가람"],
    "COMPANY": ["가온출판사", "누리연구소", "다솜재단", "라온방송", "마루협회"],
    "POSITION": ["과장", "대리", "부장", "주임"],
    "PHONE": ["02-1111-2222", "031-333-4444", "010-5555-6666"],
    "DATE": ["2021년 3월 4일", "2022년 12월 19일", "2023.05.06"],
    "MONEY": ["1,000,000원", "250,000원", "37,500원"],
    "ADDRESS": ["서울시 종로구 새길 1", "부산시 해운대구 바닷길 20"],
}
DOCUMENTS = {"contract": "저작물명: {WORK} ○\n양수자 기관명: {COMPANY},\n양도자 소속: {COMPANY},\n날짜: {DATE}\n합의", "consent": "성명: {NAME}\n주소: {ADDRESS}\n전화번호: {PHONE}\n날짜: {DATE}\n동의함"}


def pick(n: int, seed: int, *parts: Column | str) -> Column:
    """A number from 0 to n - 1 from md5 of seed, id and slot; equal in any engine that has md5."""
    words = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *words)), 1, 8), 16, 10).cast("long") % n).cast("int")


def pool_value(pool: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in pool]), index)


def _some(values: list[str], n: Column, seed: int, *parts: Column | str) -> Column:
    """n of the values in hash order, without repeats."""
    words = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    keyed = F.array(*[F.struct(F.md5(F.concat_ws("/", F.lit(str(seed)), *words, F.lit(str(i)))).alias("h"), F.lit(v).alias("v")) for i, v in enumerate(values)])
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["v"]), F.lit(1), n)


def _once(rows: DataFrame, *cols: Column) -> DataFrame:
    """id and the columns, each computed once: the generator keeps the optimizer from repeating them wherever they are used."""
    return rows.select("id", F.inline(F.array(F.struct(*cols))))


def synthesize_corpus(ids: DataFrame, seed: int = 42, id_col: str = "id", tagged: bool = True, pools: dict[str, list[str]] = POOLS) -> DataFrame:
    """G1: (id, text, entities, labels): filled templates for each id, and BIO labels of the characters.

    Two in five texts join two to four templates, three in five get one to eight (at most one of each type) more values, one in
    five ends in a line as scanners leave it.  Texts with fewer than three entities or two types are dropped.
    """
    key = F.col("id")

    def fill(template: Column, place: Column) -> Column:
        values = {k: pool_value(v, pick(len(v), seed, key, F.lit(k), place)) for k, v in pools.items()}
        text = template
        for k, value in values.items():
            text = F.replace(text, F.lit("{" + k + "}"), value)
        used = [F.when(template.contains("{" + k + "}"), F.struct(value.alias("value"), F.lit(k).alias("type"))) for k, value in values.items()]
        return F.struct(text.alias("text"), F.filter(F.array(*used), lambda e: e.isNotNull()).alias("entities"))

    def extra(kind: Column) -> Column:
        value = F.coalesce(*[F.when(kind == k, pool_value(v, pick(len(v), seed, key, k, "extra"))) for k, v in pools.items()])
        link = pool_value(CONNECTORS, pick(len(CONNECTORS), seed, key, kind, F.lit("link")))
        return F.struct(F.concat(link, value).alias("text"), F.struct(value.alias("value"), kind.alias("type")).alias("entity"))

    most = min(8, len(pools))
    n_templates = F.when(pick(100, seed, key, "many") < 40, pick(3, seed, key, "templates") + 2).otherwise(1)
    n_extra = F.when(pick(100, seed, key, "more") < 60, pick(most, seed, key, "extras") + 1).otherwise(0)
    rows = ids.select(F.col(id_col).alias("id"))
    filled, more = F.transform(_some(TEMPLATES, n_templates, seed, key, "template"), fill), F.transform(_some(list(pools), n_extra, seed, key, "type"), extra)
    rows = _once(rows, filled.alias("filled"), more.alias("extra"))
    scanned = F.when(pick(100, seed, key, "scan") < 20, pool_value(SCANNED, pick(len(SCANNED), seed, key, "scanned"))).otherwise("")
    text = F.concat(F.array_join("filled.text", "\n"), F.array_join("extra.text", ""), scanned)
    rows = _once(rows, text.alias("text"), F.concat(F.flatten("filled.entities"), F.col("extra.entity")).alias("entities"))
    rows = rows.filter((F.size("entities") >= 3) & (F.size(F.array_distinct("entities.type")) >= 2))
    if not tagged:
        return rows
    return _once(rows, F.col("text"), F.col("entities"), tag_characters(F.col("text"), F.col("entities")).alias("labels")).filter(F.exists("labels", lambda x: x != "O"))


def part_pools(part: str, share: float = 0.8, seed: int = 42) -> dict[str, list[str]]:
    """Each pool in hash order, its first share for ``train`` and the rest for ``eval``; the generators take either."""
    out = {}
    for k, pool in POOLS.items():
        ranked = sorted(pool, key=lambda v: hashlib.md5(f"{seed}/{v}".encode()).hexdigest())
        cut = int(len(pool) * share)
        out[k] = ranked[:cut] if part == "train" else ranked[cut:]
    return out


def split_value_pool(spark: SparkSession, share: float = 0.8, seed: int = 42) -> DataFrame:
    """(type, value, part)."""
    rows = [(k, v, part) for part in ("train", "eval") for k, pool in part_pools(part, share, seed).items() for v in pool]
    return spark.createDataFrame(rows, "type string, value string, part string")


def evaluation_mix(train: DataFrame, fresh: DataFrame, share: float = 0.2, seed: int = 42, id_col: str = "id") -> DataFrame:
    """All fresh samples and those of train whose hash lies below the share."""
    kept = train.filter(pick(1_000_000, seed, F.col(id_col), "mix") < int(share * 1_000_000))
    return fresh.unionByName(kept)


def synthesize_field_documents(ids: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(id, kind, text): contract and consent documents, half each by hash."""
    kind = F.when(pick(2, seed, F.col("id"), "kind") == 0, "contract").otherwise("consent")
    text = F.when(F.col("kind") == "contract", F.lit(DOCUMENTS["contract"])).otherwise(F.lit(DOCUMENTS["consent"]))
    for k, pool in POOLS.items():
        text = F.replace(text, F.lit("{" + k + "}"), pool_value(pool, pick(len(pool), seed, F.col("id"), k)))
    text = F.replace(text, F.lit("{WORK}"), F.concat(F.lit("작품 "), F.col("id").cast("string")))
    return ids.select(F.col(id_col).alias("id")).withColumn("kind", kind).select("id", "kind", text.alias("text"))


def route_field_documents(docs: DataFrame) -> DataFrame:
    """(id, kind, text, fields, route): fields extracted again from the texts, and the corpus that a document goes to.

    A document is a contract where the work or the receiving institution was found, and a consent otherwise.
    """
    found = extract_fields_best(docs.filter("kind = 'contract'"), "contract", "id").unionByName(extract_fields_best(docs.filter("kind = 'consent'"), "consent", "id"))
    fields = found.groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("fields"))
    contract = F.coalesce(F.arrays_overlap(F.map_keys("fields"), F.array(F.lit("저작물명"), F.lit("양수자 기관명"))), F.lit(False))
    return docs.select("id", "kind", "text").join(fields, "id", "left").withColumn("route", F.when(contract, "contract").otherwise("consent"))
