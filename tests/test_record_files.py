"""Files of records: names, whole jobs or none, moves that are cut off, and the sources that read trees of files."""

from __future__ import annotations

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from paperloom.operators import entities, metadata
from paperloom.sources import files
from paperloom.sources import record_files as W
from paperloom.streaming.metadata import metadata_stream

CONTRACT = "용역 계약서\n갑: 가온\n을: 나래\n2024.1.2 서명 "
CONSENT = "개인정보 수집 동의서\n성명: 김하늘\n2024.1.2\n성명: 이바다\n"


def tree(at) -> dict[str, str]:
    return {os.path.relpath(os.path.join(d, n), at): open(os.path.join(d, n)).read() for d, _, names in os.walk(at) for n in names if not n.endswith(".crc")}


def rows(spark, n):
    return spark.range(n).select(F.concat(F.lit("a/"), F.col("id") % 7, F.lit("/f"), "id", F.lit(".json")).alias("name"), F.col("id").cast("string").alias("content")).repartition(5)


def test_files_are_written_and_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    W.write_files(rows(spark, 50), out)
    assert tree(out) == {f"a/{k % 7}/f{k}.json": str(k) for k in range(50)}
    W.write_files(rows(spark, 3).withColumn("content", F.lit("é")), f"file://{out}")
    assert tree(out) == {f"a/{k % 7}/f{k}.json": "é" if k < 3 else str(k) for k in range(50)}
    W.write_files(rows(spark, 0), out)
    assert len(tree(out)) == 50


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    broken = rows(spark, 50).withColumn("content", F.when(F.col("name") == "a/3/f45.json", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no"):
        W.write_files(broken, out)
    assert not [n for n in tree(out) if not n.startswith("_staging")]
    assert W.recover(spark, out) == [] and tree(out) == {}  # a task that was still at work when the job failed
    with pytest.raises(Exception, match="leads out"):
        W.write_files(spark.createDataFrame([("../x", "y")], "name string, content string"), out)
    assert not [n for n in tree(tmp_path) if "_staging" not in n]


def test_a_move_that_was_cut_off_is_finished(spark, tmp_path):
    out = str(tmp_path / "out")
    W.stage_files(rows(spark, 20), out, "one")
    staged = tmp_path / "out/_staging/one"
    (task,) = [d for d in staged.iterdir() if (d / "files/a/5/f5.json").exists()]
    os.makedirs(f"{out}/a/5")
    shutil.move(task / "files/a/5/f5.json", f"{out}/a/5/f5.json")  # as far as it came
    os.makedirs(f"{out}/_staging/two/9-9/files")  # a job that was never committed
    assert W.recover(spark, out) == ["one"]
    assert tree(out) == {f"a/{k % 7}/f{k}.json": str(k) for k in range(20)} and not os.listdir(f"{out}/_staging")


def test_record_and_entity_files(spark, tmp_path):
    df = spark.createDataFrame([("/in/x/c.txt", CONTRACT), ("/in/y/d.e.txt", CONSENT), ("/in/z.txt", CONSENT.split("성명: 이")[0])], "path string, text string")
    records = metadata.consent_records(df, "path").withColumnRenamed("doc_id", "path")
    metadata.write_records(records, str(tmp_path / "records"), "/in")
    got = tree(tmp_path / "records")
    assert set(got) == {"y/d.e__00.json", "y/d.e__01.json", "z.json"}
    assert json.loads(got["y/d.e__01.json"])["subject"]["name"] == "이바다" and "path" not in json.loads(got["z.json"])
    found = spark.createDataFrame([(1, "김하늘", "NAME"), (1, "가온재단", "COMPANY"), (1, "이바다", "NAME")], "doc_id long, value string, type string")
    entities.write_entity_results(found, spark.createDataFrame([(1, "/in/x/c.txt"), (2, "/in/x/e.txt")], "doc_id long, path string"), str(tmp_path / "entities"), "/in/")
    got = tree(tmp_path / "entities")
    assert {k: json.loads(v) for k, v in got.items()} == {"x/c_entities.json": {"file": "/in/x/c.txt", "entities": {"COMPANY": ["가온재단"], "NAME": ["김하늘", "이바다"]}, "entity_count": 3, "entity_types": ["COMPANY", "NAME"]}}


def test_stream_that_is_killed_between_write_and_commit(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.txt").write_text(CONTRACT + str(i))
    at = [str(tmp_path / x) for x in ("in", "out", "check")]
    with monkeypatch.context() as m:
        m.setattr(W, "move_files", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            metadata_stream(spark, *at).awaitTermination(120)
    assert not [n for n in tree(at[1]) if not n.startswith("_staging")]
    (tmp_path / "in/9.txt").write_text(CONTRACT + "9")
    metadata_stream(spark, *at).awaitTermination(120)
    assert set(tree(at[1])) == {"0.json", "1.json", "2.json", "9.json"}


def test_conll_file_cut_in_many_tasks(spark, tmp_path):
    lines = []
    for k in range(3000):
        lines.append(f"w{k}\tB-X" if k % 3 else ["", "", " \t", "\r", "broken", "\n"][k % 6])
    (tmp_path / "one.conll").write_text("\n".join(lines))
    (tmp_path / "two.conll").write_text("a\tO\n\nb\tO\n")
    text = {p: (tmp_path / p).read_bytes().decode() for p in ("one.conll", "two.conll")}
    want = {(r.path, r.sent_id, *r.tokens) for r in files.parse_conll(spark.createDataFrame(list(text.items()), "path string, text string")).collect()}
    for conf, value in (("spark.sql.files.maxPartitionBytes", "3000"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(conf, value)
    try:
        df = files.read_conll(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 7
        assert {(r.path.rsplit("/")[-1], r.sent_id, *r.tokens) for r in df.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_folder_parts(spark):
    data = [(f"/r/{f}/{k:03}.txt", None if k == 7 else f" {f}\t{k} ") for f in "ab" for k in range(200)] + [("/r/b/sub/x.txt", "x"), ("/q/s1/1.txt", " "), ("/q/s2/2.txt", "two")]
    df = spark.createDataFrame(data, "path string, text string").repartition(6)
    whole = {r.folder: (r.text, r.n_files) for r in files.folder_documents(df).collect()}
    assert whole["/r/a"] == ("\n".join(f" a\t{k} " for k in range(200) if k != 7), 200) and whole["/q"] == (" \ntwo", 2)
    parts = files.folder_parts(df, part_chars=100).filter("folder = '/r/b'").orderBy("first").collect()
    assert len(parts) > 10 and "\n".join(p.text for p in parts if p.with_text) == whole["/r/b"][0] and sum(p.n_files for p in parts) == 200
    spaced = {r.folder: r.text for r in files.folder_documents(df, " ", True).collect()}
    assert spaced["/r/a"] == " ".join(f"a {k}" for k in range(200) if k != 7) and spaced["/q"] == "two" and spaced["/q/s1"] == ""


def test_scan_lists_only_what_is_asked_for(spark, tmp_path):
    for provider, category, doc in [("google", "계약서", "a"), ("google", "동의서", "b"), ("x,y", "계약서", "c")]:
        at = tmp_path / provider / category / doc
        at.mkdir(parents=True)
        (at / f"{doc}_extracted_text.txt").write_text(f"{provider} {doc}")
    root = str(tmp_path)
    scan = lambda *a: sorted(tuple(r) for r in files.scan_ocr_results(spark, root, *a).collect())
    assert scan() == [("google", "계약서", "a", "google a"), ("google", "동의서", "b", "google b"), ("x,y", "계약서", "c", "x,y c")]
    assert scan(["google"]) == scan()[:2] and scan(["x,y"], ["계약서"]) == scan()[2:] and scan(None, ["동의서"]) == scan()[1:2]


def test_trees_are_listed_and_read_by_tasks(spark, tmp_path):
    made = {"a.txt": b"one", "d/b.txt": "둘".encode("cp949"), "d/e/빈 칸.md": b"", "d/e/f/c.json": b"{}", "_staging/x.txt": b"no", "d/.x.txt.crc": b"no", "k=_1/y.txt": b"yes"}
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    root = str(tmp_path)
    listed = files.list_files(spark, root)
    assert listed.count() == 5 and listed.filter("length = 0").count() == 1
    spark_own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    assert sorted(listed.select("path", "length").filter("length > 0").collect()) == sorted(spark_own.select("path", "length").collect())
    assert "FileScan" not in listed._jdf.queryExecution().executedPlan().toString()  # Spark's own sources list in the driver
    assert sorted(files._files(spark, f"file://{root}", ".txt", ".md").collect()) == sorted(spark_own.filter("path NOT LIKE '%.json'").select("path", "content").collect())
    with pytest.raises(FileNotFoundError):
        files.inventory_files(spark, root + "/none")
    scan = files.scan_ocr_results(spark, root, ["none"])
    assert scan.count() == 0 and "FileScan" not in scan._jdf.queryExecution().executedPlan().toString()


def test_stream_goes_over_a_table_of_names(spark, tmp_path):
    (tmp_path / "in/빈 칸").mkdir(parents=True)
    at = [str(tmp_path / x) for x in ("in", "out", "check")]
    for i in range(30):
        (tmp_path / f"in/빈 칸/{i}.txt").write_text(CONTRACT + str(i))
    one = metadata_stream(spark, *at)
    one.awaitTermination(120)
    assert len(tree(at[1])) == 30 and one.lastProgress["numInputRows"] == 30  # each name once, and no whole text in the source
    assert "text" not in spark.read.parquet(f"{at[2]}/arrivals").columns
    two = metadata_stream(spark, *at)
    two.awaitTermination(120)
    assert spark.read.parquet(f"{at[2]}/arrivals").count() == 30 == len(tree(at[1]))


def test_no_folder_is_left_of_a_job(spark, tmp_path):
    W.write_files(spark.range(40).select(F.concat(F.col("id"), F.lit("/x/f.txt")).alias("name"), F.lit("x").alias("content")), str(tmp_path))
    assert len(tree(tmp_path)) == 40 and not os.listdir(tmp_path / "_staging")
