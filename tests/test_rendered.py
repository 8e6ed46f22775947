"""Rows are spread by their key right before texts are rendered of them, whatever the join before does."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from paperloom.operators import checkboxes, entities, fields
from paperloom.catalog import QUERIES
from paperloom.plans import corpus
from paperloom.plans.rendered import ANSWERS, DOCUMENTS, parts_of_text, tokens, view
from paperloom.plans.services import _PAPERS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sql", [DOCUMENTS, ANSWERS, _PAPERS])
def test_texts_are_rendered_in_all_partitions(spark, sql):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = view(spark, SF, sql).rdd
        assert made.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert min(made.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_values_are_tested_before_they_are_rows(spark):
    plan = entities.extract_entities(view(spark, SF, DOCUMENTS))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (CASE WHEN" not in plan


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("sql", [DOCUMENTS, ANSWERS, _PAPERS])
def test_a_text_is_rendered_once(spark, sql):
    rows = view(spark, SF, sql).filter("text IS NOT NULL").select("doc_id", F.length("text"))
    assert _plan(rows).count("lpad(") == _plan(view(spark, SF, sql)).count("lpad(")
    assert "Filter isnotnull(text" in _plan(rows)


def test_ticks_of_a_text_are_searched_once(spark):
    odd = ["☑ 복제권 📧\n공연권", "☑☑ 전시권", "■복제", "● reproduction", "", None, "□ 복제권 ◉\t\t2차적저작물", "복제권 ✓"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    own = checkboxes.extract_license(df)
    assert "RLIKE" not in _plan(own)
    want = df.select("doc_id", *[checkboxes.ticked(F.col("text"), *names).alias(k) for k, names in checkboxes.RIGHTS.items()])
    assert sorted(own.select(*want.columns).collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["fields_simple", "fields_ranked", "fields_best", "fields_earliest"])
def test_documents_of_both_kinds_are_read_in_one_pass(spark, name):
    assert "Union" not in _plan(QUERIES[name](spark, SF))


def test_words_of_a_pattern_are_in_each_match():
    assert fields._words(r"양도자\s*본인은.*?([가-힣]{2,4})\s*\(") == ["양도자", "본인은"]
    assert fields._words(r"주소\s*[:：]\s*([^\n]+?)(?:\s*양수인|\s*\z)") == ["주소"] and fields._words(r"(동의함|동의)") == []


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_dates_of_a_contract_are_searched_once(spark):
    assert _plan(QUERIES["contract_records"](spark, SF)).count("(20") == 4  # the search, and the three parts of each date found


def test_tokens_of_a_sentence_stay_together(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(corpus.decode_spans(spark, SF)) == 1  # before words become rows
        assert _exchanges(corpus.conll_round_trip(spark, SF)) == 1
        plan = corpus.choose_engine("consensus")(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" in plan and not [x for x in plan.split("Exchange ")[1:] if "ENSURE_REQUIREMENTS" in x.split("\n")[0] and "provider" in x.split("\n")[0]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_characters_are_not_sent_to_their_tokens(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(corpus.expand_labels(spark, SF)) == 3  # documents for tokens and for characters, and the sums of labels
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_entities_of_documents_that_come_once_are_not_sent(spark, tmp_path):
    plan = _plan(QUERIES["extract_entities"](spark, SF))
    alone, more = plan.split("Union", 1)[1].split("Aggregate", 1)
    # documents are dealt to the search of each, and only those that come more than once are sent after it
    assert alone.count("RepartitionByExpression") == 1 and more.count("RepartitionByExpression") == 2
    assert plan.count("ArrowEvalPython") == 2 and "(copies" in alone[: alone.index("RepartitionByExpression")]
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.unionAll(orders.filter("o_orderkey % 3 = 0")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    got, want = QUERIES["extract_entities"](spark, str(tmp_path)).collect(), QUERIES["extract_entities"](spark, SF).collect()
    assert len(got) == len(set(got)) and set(got) == set(want)


def test_text_is_dealt_to_partitions_of_a_size(spark):
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert parts_of_text(spark, SF) == max(usual, -(-size // (1 << 21))) and parts_of_text(spark, SF, 1000) == -(-size // 1000) > usual
    assert tokens(spark, SF, 9).rdd.getNumPartitions() == 9
