"""Golden cases of the document operators; all values are made up."""

from __future__ import annotations

import hashlib
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom import catalog
from paperloom.functions import classify as C
from paperloom.functions import text as T
from paperloom.operators import checkboxes, entities, evaluate, fields, grammar, metadata, models, ocr, records, sequence, synth
from paperloom.sources import files
from paperloom.streaming.metadata import metadata_stream


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column_of, text):
    return docs(spark, text).select(column_of(F.col("text")).alias("x")).first().x


def test_masking_and_dates(spark):
    assert one(spark, T.mask_resident_id, "번호 900101-1234567 끝") == "번호 ******-******* 끝"
    r = one(spark, T.extract_date_range, "2024.3.5")
    assert (r.effective_date, r.expiry_date) == ("2024-03-05", "2024-03-05")
    r = one(spark, T.extract_date_range, "2024년 3월 5일 ~ 2025-12-31")
    assert (r.effective_date, r.expiry_date) == ("2024-03-05", "2025-12-31")
    assert tuple(one(spark, T.extract_date_range, "없음")) == (None, None)


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.extract_amount, "계약금: 5,000,000원", 5000000),
        (T.extract_amount, "없음", None),
        (T.coerce_payment_amount, "1,000", 1),
        (T.coerce_payment_amount, "none", None),
        (T.clean_entity, " :,-a b. ", "a b"),
        (T.collapse_whitespace, " a\n\t b ", "a b"),
        (T.parse_model_json, 'x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
        (T.parse_model_json, "{broken", "{}"),
        (T.parse_model_json, "", "{}"),
        (T.normalize_consent_status, "✗", "동의하지 않음"),
        (T.normalize_consent_status, "?", "null"),
        (T.normalize_consent_status, None, None),
        (T.strip_markdown, "**a** `b`\n\n\n\nc", "a b\n\nc"),
        (T.safe_file_name, " a b/c?.txt ", "a_bc.txt"),
        (C.detect_doc_type, "갑과 을", "계약서"),
        (C.detect_doc_type, "그냥", "동의서"),
        (C.category_from_anchor, "/x/data/folder/f.txt", "folder"),
        (C.category_from_anchor, "/x/y", None),
        (C.document_type_from_title, "저작재산권 양도동의서", "저작재산권 양도동의서"),
        (checkboxes.checkbox_pattern, "■ x", "A"),
        (checkboxes.dominant_glyph, "■■ ☑", "■"),
    ],
)
def test_text_functions(spark, f, text, want):
    assert one(spark, f, text) == want


def test_pack_sentences(spark):
    f = lambda c: T.pack_sentences(c, 12)
    assert one(spark, f, "short") == ["short"]
    assert one(spark, f, "aaaa. bbbb\ncccc. dddddddddddddddd.") == ["aaaa. bbbb.", "cccc.", "dddddddddddddddd."]


@pytest.mark.parametrize(("value", "kind", "want"), [("2024년", "DATE", False), ("양도자", "NAME", False), ("KBS", "COMPANY", True), ("한국", "COMPANY", False), ("김하늘", "NAME", True), (None, "NAME", False), ("a", None, False)])
def test_validity(spark, value, kind, want):
    df = spark.createDataFrame([(value, kind)], "v string, k string")
    assert df.select(entities.is_valid_entity(F.col("v"), F.col("k")).alias("x")).first().x is want


def test_entities_and_union(spark):
    df = docs(spark, "담당 김하늘 과장, 연락처: 02-123-4567, mail a.b@example.com 계약금: 1,000원", None, "")
    got = {(r.value, r.type) for r in entities.extract_entities(df).collect()}
    assert {("김하늘", "NAME"), ("02-123-4567", "PHONE"), ("a.b@example.com", "EMAIL"), ("1,000원", "MONEY")} <= got
    model = spark.createDataFrame([(0, "ABC", "COMPANY")], "doc_id long, value string, type string")
    rule = spark.createDataFrame([(0, "abc ", "DESCRIPTION")], "doc_id long, value string, type string")
    assert [tuple(r) for r in entities.merge_entities(model, rule).collect()] == [(0, "ABC", "COMPANY", "model")]
    grouped = entities.group_entities_by_type(entities.extract_entities(df)).first()
    assert grouped.entity_count == len(got) and set(grouped.entities) == {t for _, t in got}


def test_parties_and_subjects(spark):
    text = "갑: 가온(주) 130-81-12345\n을 ： 김하늘, 010-1111-2222"
    got = {r.role: (r.name, r.registration_no) for r in metadata.extract_parties(docs(spark, text, None)).collect()}
    assert got["갑"] == ("가온(주)", "130-81-12345") and got["을"][0].startswith("김하늘")
    two = "성명: 김하늘\n2020-01-02\n성명: 박구름\n010-1111-2222 2021.3.4"
    rows = metadata.extract_consent_subjects(docs(spark, two)).orderBy("subject_index").collect()
    assert [(r.subject_index, r.date_signed, r.contact_phone) for r in rows] == [(0, "2020-01-02", None), (1, "2021-03-04", "010-1111-2222")]
    assert metadata.consent_records(docs(spark, "내용 없음", None)).count() == 1


def test_fields(spark):
    df = docs(spark, "저작물명: 새 노래\n양도자 소속: 가온\n합의", "")
    best = {r.label: r.value for r in fields.extract_fields_best(df, "contract").collect()}
    assert best["동의여부"] == "합의" and "날짜" not in best
    simple = {r.label: r.value for r in fields.extract_fields_simple(df, "contract").collect()}
    assert simple["저작물명"] == "새 노래" and simple["양도자 소속"] == "가온"
    wide = fields.fields_wide(fields.extract_fields_simple(df, "contract"), ["저작물명", "날짜"]).first()
    assert (wide["저작물명"], wide["날짜"]) == ("새 노래", "")
    spans = fields.rows_to_labelled_text(spark.createDataFrame([(1, "ab", None, "c")], "doc_id long, x string, y string, z string"), ["x", "y", "z"]).collect()
    assert [(r.text, r.label, r.start, r.end) for r in spans] == [("ab c", "x", 0, 2), ("ab c", "z", 3, 4)]


def test_earliest_match_wins(spark):
    df = docs(spark, "성명: 하하하\n전화번호: 010-9999-9999\n성명: 가가가\n전화번호: 010-1111-1111", "", None)
    rows = fields.field_candidates(df, "consent")
    hits = {(r.hit, r.value) for r in rows.collect() if r.label == "양수인 성명" and r.pattern_rank == 1}
    assert hits == {(0, "하하하"), (1, "가가가")}
    best = {r.label: r.value for r in fields.rank_candidates(rows).collect()}
    assert best["양수인 성명"] == "하하하"
    wide = fields.fields_wide(rows, ["양수인 성명", "동의여부"], ("pattern_rank", "hit")).collect()
    assert [(r["양수인 성명"], r["동의여부"]) for r in wide] == [("하하하", "")]
    agreed = fields.field_candidates(docs(spark, "모두 승인", "끝"), "consent").collect()
    assert [(r.doc_id, r.label, r.pattern_rank, r.hit, r.value) for r in agreed] == [(0, "동의여부", 0, 0, "승인")]


@pytest.mark.parametrize("text", ["저작물명: 테스트 (📧복제권, ☐공연권, 📧공중송신권)", "저작물명: 테스트 (☑복제권, □공연권, ☑공중송신권)"])
def test_checkboxes(spark, text):
    got = {r.key: r.checked for r in checkboxes.extract_checkboxes(docs(spark, text, None), "contract").collect()}
    assert got["reproduction"] and got["broadcasting"] and not got["performance"]


def test_ocr_lines_and_engines(spark):
    box = lambda t, x, y: {"inferText": t, "inferConfidence": 0.5, "boundingPoly": {"vertices": [{"x": x, "y": y}]}}
    page = {"images": [{"fields": [box("c", 0, 40), box("a", 0, 10), box("b", 9, 28), {"inferText": "no place"}]}]}
    df = spark.createDataFrame([(1, json.dumps(page)), (2, "{broken")], "doc_id long, response string")
    words = ocr.parse_ocr_fields(df)
    assert [r.text for r in ocr.group_ocr_lines(words).collect()] == ["a b\nc"]
    assert ocr.ocr_confidence(words).first().confidence == pytest.approx(0.375)
    pages = spark.createDataFrame([(1, 1, "google", "", "failed"), (1, 1, "naver", "abcd", "success"), (1, 1, "z", "abce", "success"), (1, 2, "google", "x", "success")], "doc_id long, page_number int, provider string, extracted_text string, status string")
    best = ocr.choose_ocr_engine(pages)
    assert {(r.page_number, r.provider) for r in best.collect()} == {(1, "naver"), (2, "google")}
    assert ocr.assemble_ocr_documents(best).first().full_text == "abcd" + ocr.PAGE_BREAK + "x"
    tree = {"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [{"symbols": [{"text": "a", "confidence": 0.9}, {"text": "b"}]}]}]}]}]}}
    symbols = ocr.parse_ocr_symbols(spark.createDataFrame([(1, json.dumps(tree))], "doc_id long, response string"))
    assert ocr.ocr_confidence(symbols).first().confidence == pytest.approx(0.45)


def test_edit_distance_in_bands(spark):
    random.seed(5)
    word = lambda n: "".join(random.choice("가나ab ") for _ in range(n))
    rows = [(word(random.randint(0, 400)), word(random.randint(0, 400))) for _ in range(60)] + [("", ""), ("가", None)]
    rows += [(t, t[:50] + "x" * k + t[60:]) for k in (0, 9, 40, 300) for t in [word(500)]]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.filter(~ocr.edit_distance(F.col("a"), F.col("b")).eqNullSafe(F.levenshtein("a", "b"))).count() == 0
    page = word(6000)
    near = [page, page[:4000] + "ㄱㄴ" + page[4000:], page[:500] + "ㄷ" + page[501:], page[:900] + "ㄷ" * 20 + page[920:]]
    pages = spark.createDataFrame([(1, 1, f"p{i}", t, "success") for i, t in enumerate(near)], "doc_id long, page_number int, provider string, extracted_text string, status string")
    assert [r.provider for r in ocr.choose_ocr_engine(pages, "consensus").collect()] == ["p0"]


def tag(spark, labels, mode="strict"):
    rows = [(1, i, i + 1 if i else 1, i + 2 if i else 1 + 1, x, 0.9) for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "sent_id int, pos int, start int, end int, label string, confidence double")
    return [(r.type, r.start, r.end) for r in sequence.decode_bio(df, mode=mode).orderBy("start").collect()]


def test_decode(spark):
    assert tag(spark, ["B-A", "I-A", "I-B", "B-B", "O", "I-A"]) == [("A", 1, 3), ("B", 4, 5)]
    assert [x[0] for x in tag(spark, ["B-A", "I-B", "O", "I-A"], "lenient")] == ["A", "B", "A"]


def test_tag_characters_round_trip(spark):
    df = spark.createDataFrame([("연합뉴스 소속 직원", [("연합뉴스", "COMPANY"), ("연합", "NAME")]), ("a b", [("a b", "X")]), ("", [])], "text string, e array<struct<value:string,type:string>>")
    got = [r.x for r in df.select(sequence.tag_characters(F.col("text"), F.col("e")).alias("x")).collect()]
    assert got == [["B-COMPANY", "I-COMPANY", "I-COMPANY", "I-COMPANY", *["O"] * 6], ["B-X", "O", "I-X"], []]


def test_tags_of_long_texts_overlaps_and_gaps(spark):
    text = "가나다 라마 " * 20_000
    df = spark.createDataFrame([(text, [("라마", "B"), ("가나다 라마", "A"), (" 가", "C")]), (None, []), ("aaa", None), ("aaa", [("aa", "X"), ("aa", "Y"), ("", "Z")])], "text string, e array<struct<value:string,type:string>>")
    got = [r.x for r in df.select(sequence.tag_characters(F.col("text"), F.col("e")).alias("x")).collect()]
    assert got[0] == ["B-A", "I-A", "I-A", "O", "I-A", "I-A", "O"] * 20_000
    assert got[1:] == [None, ["O", "O", "O"], ["B-X", "I-X", "O"]]


def test_entity_patterns_search_runs_once(spark):
    # what begins in the middle of a run, right after a match, is found as by a plain search
    text = "a@b.co_x@c.de 가나시 다구 라마길바사시 아군 자로 " + "가" * 30_000 + " " + "x" * 30_000 + " 나다회사라원마"
    found = {(r.type, r.value) for r in entities.extract_entities(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert {("EMAIL", "a@b.co"), ("EMAIL", "_x@c.de"), ("COMPANY", "나다회사라원"), ("ADDRESS", "가나시 다구 라마길바사시 아군 자로")} <= found


def test_rules_pass_over_many_texts_at_once(spark):
    # texts are searched together, and find what each pattern finds alone, from left to right, in each of them
    parts = ["김하늘", " 과장", "대표이사", "님", "협회사", "주식회사", "연구원", "원부", "010-123-", "4567-8901", "234-5678", "12024-1-2", "345", "1,234,", "99", "원", "가시 ", "다구\n", "로 ", "길1", "a@", "b.co", "_x", "성명:", "갑:", "주소:", "소속: ", "회사:", "금", "2024", "년 1", "월 2일", ".1", "/2/2024", "□", ".", " ", "\0", "\x1c", "📧"]
    drawn = [int(hashlib.md5(str(i).encode()).hexdigest(), 16) for i in range(600)]
    texts = ["".join(parts[(x >> 6 * k) % len(parts)] for k in range(1 + x % 20)) for x in drawn] + [None, "", "가" * 300_000 + "원 " + "a" * 300_000 + "@b.co"]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    own = entities.extract_entities(df)
    got, want = own.collect(), entities.extract_entities(df, rules=list(entities.RULES)).collect()
    assert own.columns == ["doc_id", "value", "type"] and len(set(got)) == len(got) == len(want) and set(got) == set(want)
    assert {r.type for r in got} == {r.type for r in entities.RULES} and any(r.doc_id is None for r in got)
    counted = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    again = counted.unionAll(counted.filter("doc_id > 300")).withColumn("n", F.when(F.col("doc_id") > 300, F.col("n") * 2).otherwise(F.col("n")))
    assert sorted(map(str, entities.extract_entities(again, copies="n").collect())) == sorted(map(str, want))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan


def test_values_are_tested_as_columns_are(spark):
    words = [*entities.GLYPHS, *entities.PARTICLES, *entities.NAME_VERBS, *entities.NAME_ROLES, *entities.NAME_EXCEPTIONS, *entities.COMPANY_NOUNS, *entities.SHORT_COMPANIES, *entities.FILE_ENDINGS, "국법원", "가로부", "처", "12", "2024년", "010-1234-5678", "--1-2-3-4-5-6", "원", "1,0원", "가나다라", "a.b", "a,b", "(가", "가)", "가\n나\n다라마바", "가" * 51, "", " ", "\t\n", "٣٣"]
    values = sorted({a + b for a in words for b in ("", "자", "원", ".", "\n가나", "처")})
    kinds = list(dict.fromkeys(r.type for r in entities.RULES))
    v, k = F.col("v"), F.col("k")
    holds = F.when(k.isin("EMAIL", "MONEY"), entities._shape(k, v)).otherwise(entities._shape(k, v) & entities.is_valid_entity(v, k))
    rows = spark.createDataFrame([(a, b) for a in values for b in kinds], "v string, k string").select("v", "k", holds.alias("x")).collect()
    tests = {kind: entities.value_test(kind) for kind in kinds}
    assert [r for r in rows if tests[r.k](r.v) is not r.x] == []


def test_tokens_take_the_labels_of_their_first_characters(spark):
    columns = "sent_id long, start int, end int, label string, words array<string>"
    tokens = spark.createDataFrame([(1, 0, 3, "B-A", ["x"]), (1, 0, 2, "O", None), (1, 5, 6, "I-A", []), (2, 0, 1, "I-B", None), (2, 7, 7, "B-B", None), (2, None, 1, "B-B", None), (None, 0, 1, "B-C", ["y"]), (None, 0, 1, "B-C", ["z"])], columns)
    chars = spark.createDataFrame([(1, 0, "B-X"), (1, 0, "O"), (1, 1, "I-X"), (1, 5, None), (2, 0, "I-B"), (2, None, "B-Y"), (None, 0, "B-Z"), (3, 0, "B-Z")], "sent_id long, char_pos long, label string")
    got = sequence.token_labels_of_chars(tokens, chars)
    assert got.columns == ["sent_id", "start", "end", "words", "label"] and dict(got.dtypes) == dict(tokens.dtypes)
    want = [(1, 0, 3, ["x"], "B-X"), (1, 0, 3, ["x"], "O"), (1, 0, 2, None, "B-X"), (1, 0, 2, None, "O"), (1, 5, 6, [], "O"), (2, 0, 1, None, "I-B"), (2, 7, 7, None, "O"), (2, None, 1, None, "O"), (None, 0, 1, ["y"], "O"), (None, 0, 1, ["z"], "O")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_split_parts(spark):
    rows = [(i, ["B-A"] if i % 3 == 0 else ["O", "B-B", "B-A"] if i % 3 == 1 else ["O"]) for i in range(200)]
    s = sequence.stratified_split(spark.createDataFrame(rows, "sent_id long, labels array<string>")).collect()
    train, held = {r.sent_id for r in s if r.split == "train"}, {r.sent_id for r in s if r.split != "train"}
    assert not train & held and train | held == set(range(200))


def test_scores(spark):
    schema = "sent_id int, type string, start int, end int"
    gold = spark.createDataFrame([(1, "A", 0, 2), (1, "B", 3, 4)], schema)
    pred = spark.createDataFrame([(1, "A", 0, 2), (1, "B", 3, 5)], schema)
    r = evaluate.evaluate_entities(gold, pred).first()
    assert (r.precision, r.recall, r.f1) == (50.0, 50.0, 50.0)
    assert evaluate.evaluate_entities(gold.limit(0), pred.limit(0)).first().f1 == 0.0


def test_records(spark):
    df = spark.createDataFrame([("매매", None, "x", 2.0)], "contract_type string, rights_holder string, user string, confidence double")
    assert records.validate_records(df, "contract").first()._validation_errors == ["rights_holder: is required", "confidence: is too large"]
    assert records.validate_records(df, "general").first()._validation_errors == ["document_type: is required", "title: is required"]


def test_synthesis_is_stable(spark):
    a = {r.id: r.text for r in synth.synthesize_corpus(spark.range(40), tagged=False).collect()}
    b = {r.id: r.text for r in synth.synthesize_corpus(spark.range(40).repartition(7), tagged=False).collect()}
    assert a == b and not any("{" in t for t in a.values())
    rows = synth.split_value_pool(spark).collect()
    assert {(r.type, r.value) for r in rows} == {(k, v) for k, pool in synth.POOLS.items() for v in pool} and len(rows) == sum(map(len, synth.POOLS.values()))


def test_generators_keep_to_their_part(spark):
    pools = synth.part_pools("eval")
    rows = synth.synthesize_corpus(spark.range(60), pools=pools).collect()
    assert 40 < len(rows) <= 60 and all(e.value in pools[e.type] for r in rows for e in r.entities)
    assert all(len(r.labels) == len(r.text) and len(r.entities) >= 3 and len({e.type for e in r.entities}) >= 2 for r in rows)
    assert any("\n" in r.text for r in rows) and any(len(r.entities) > 8 for r in rows)


def test_routes_follow_what_is_found(spark):
    made = synth.synthesize_field_documents(spark.range(20))
    odd = made.limit(0).unionByName(spark.createDataFrame([(90, "contract", None), (91, "contract", ""), (92, "contract", "저작물명: 바람 ○")], made.schema))
    rows = synth.route_field_documents(made.unionByName(odd)).collect()
    assert len(rows) == 23 and all(r.route == r.kind for r in rows if r.id < 90)
    assert {r.id: r.route for r in rows if r.id >= 90} == {90: "consent", 91: "consent", 92: "contract"}


def test_models(spark):
    def load():
        return lambda texts: [[(0, len(t), "B-X", 0.9)] for t in texts]

    got = models.predict_tokens(docs(spark, "ab", None), load).collect()
    assert [(r.doc_id, r.end, r.label) for r in got] == [(0, 2, "B-X")]

    def bad():
        def call(prompt):
            raise RuntimeError("down")

        return call

    def good():
        return lambda prompt: 'Sure ```json\n{"title": "t"}\n```'

    df = docs(spark, "text").withColumn("document_type", F.lit("general"))
    r = models.extract_with_model(df, "{}", [("first", bad), ("second", good)]).collect()
    assert [(x.model_used, x.metadata, x.error) for x in r] == [("second", '{"title": "t"}', None)]
    r = models.extract_with_model(df, "{}", [("first", bad)]).first()
    assert r.metadata == "{}" and "down" in r.error


def test_stratified_split_ranks_in_parts(spark):
    df = spark.createDataFrame([(i, ["B-A", "O"] if i % 3 else ["O"]) for i in range(3000)], "sent_id long, labels array<string>")
    out = sequence.stratified_split(df)
    want = {}
    for ids in ([i for i in range(3000) if i % 3], range(0, 3000, 3)):
        order = sorted(ids, key=lambda i: hashlib.md5(f"42/{i}".encode()).hexdigest())
        a, n = int(len(order) * 0.8), int(len(order) * 0.1)
        want |= {i: "train" if k < a else "validation" if k < a + n else "test" for k, i in enumerate(order)}
    assert {(r.sent_id, r.split) for r in out.collect()} == set(want.items())
    ranked = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number()" in x and "Window" in x]
    assert ranked and all("part" in x.split("row_number()")[1].split("specifiedwindowframe")[0] for x in ranked)


@pytest.mark.parametrize("fails", [0, 1])
def test_models_are_asked_once(spark, tmp_path, fails):
    """A provider that fails at its first call for a prompt only, or at every later one only, neither loses nor repeats a row."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def flaky():
        def call(prompt):
            mark = calls / hashlib.md5(prompt.encode()).hexdigest()
            n = len(mark.read_bytes()) if mark.exists() else 0
            with mark.open("ab") as f:
                f.write(b"x")
            if (n > 0) == bool(fails):
                raise TimeoutError("slow")
            return "{}"

        return call

    df = docs(spark, *(f"text {i}" for i in range(20))).withColumn("document_type", F.lit("general"))
    got = models.extract_with_model(df, "{}", [("first", flaky), ("second", lambda: lambda prompt: "{}")])
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in df.collect())
    assert {r.model_used for r in got.collect()} == {"first" if fails else "second"}
    assert [len(m.read_bytes()) for m in calls.iterdir()] == [1] * 20


def test_files(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/1.txt").write_bytes("가나다라마바사아자차카".encode("cp949"))
    (tmp_path / "in/a/2.md").write_text("hello world text")
    (tmp_path / "in/a/3.txt").write_text("short")
    corpus = files.read_text_corpus(spark, str(tmp_path / "in"))
    assert sorted(r.text for r in corpus.collect()) == ["hello world text", "가나다라마바사아자차카"]
    assert {r.kind for r in files.inventory_files(spark, str(tmp_path / "in")).collect()} == {"text"}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("document.pdf", "image.jpg", "sheet.xlsx", "d/another.PDF", "v.mp4", "t.txt"):
            z.writestr(name, name)
    (tmp_path / "zips").mkdir()
    (tmp_path / "zips/one.zip").write_bytes(buffer.getvalue())
    (tmp_path / "zips/bad.zip").write_bytes(b"no zip")
    members = files.list_archive_members(spark, str(tmp_path / "zips"))
    assert members.filter("is_pdf").count() == 2 and members.filter("error IS NOT NULL").count() == 1
    assert [(r.total, r.pdf, r.other) for r in records.archive_totals(members).collect()] == [(6, 2, 4)]
    assert {r.name for r in files.extract_archive_members(spark, str(tmp_path / "zips")).filter("error IS NULL").collect()} == {"one_document.pdf", "one_another.PDF"}


def test_conll(spark, tmp_path):
    text = "a\tB-X\n \tO\nb\tI-X\n\nc\tO\nbroken line\n"
    df = spark.createDataFrame([("f", text)], "path string, text string")
    rows = files.parse_conll(df).orderBy("sent_id").collect()
    assert [(r.tokens, r.labels) for r in rows] == [(["a", "b"], ["B-X", "I-X"]), (["c"], ["O"])]
    files.write_conll(files.parse_conll(df), str(tmp_path / "out"))
    assert files.read_conll(spark, str(tmp_path / "out")).agg(F.sum(F.size("tokens"))).first()[0] == 3


def test_csv_and_log(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿x,y\n1,2\n".encode())
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    df = files.read_field_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert df.columns == ["x", "y", "z"] and df.count() == 2
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.json").write_text('{"timestamp": "2024-01-01T00:00:00", "status": 200}')
    assert files.read_request_log(spark, str(tmp_path / "log")).first().status == 200


def test_folder_documents(spark):
    df = spark.createDataFrame([("/r/a/2.txt", "two"), ("/r/a/1.txt", "one"), ("/r/b/3.txt", "three")], "path string, text string")
    got = {r.folder: r.text for r in files.folder_documents(df).collect()}
    assert got == {"/r/a": "one\ntwo", "/r/b": "three", "/r": "one\ntwo\nthree"}


def test_folder_digests(spark):
    # folders with and without files of their own, names that sort around the slash, null texts, one path twice
    paths = ["/r/a/2", "/r/a/1", "/r/a-b/1", "/r/a/x y", "/r/b/3", "/s/1", "/s/t/1", "/s/t/2", "/q/v/w/1", "top", "u/1", "/9", "/r/a/1", "/q/v/w/0"]
    df = spark.createDataFrame([(p, None if p.endswith("0") or p == "u/1" else f" {p}  {k}é") for k, p in enumerate(paths)], "path string, text string").repartition(5)
    for options in ({}, {"sep": " ", "collapse": True}):
        want = {(r.folder, hashlib.md5(r.text.encode()).hexdigest(), r.n_files) for r in files.folder_documents(df, **options).collect()}
        made = files.folder_digests(df, **options)
        assert {tuple(r) for r in made.collect()} == want and len(want) == 10 and made.count() == 10


def test_folder_query_gathers_no_folder(spark):
    plan = catalog.QUERIES["folder_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_join" not in plan


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "계약서\n갑: 가온\n을: 나래\n2024-01-02"
    for i in range(3):
        (tmp_path / f"in/{i}.txt").write_text(text + str(i))
    for _ in range(2):
        metadata_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r.checksum_sha256 for r in spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / "out")).collect()}
    df = docs(spark, *[text + str(i) for i in range(3)])
    assert got == {r.checksum_sha256 for r in metadata.contract_records(df).collect()} and len(got) == 3


def test_classes_branch_by_branch(spark):
    # golden cases, one for each branch
    names = {"용역계약서.pdf": "계약서", "CONSENT.txt": "동의서", "저작_양도동의서.pdf": "동의서", "양도_1.pdf": "저작재산권 양도동의서", "transfer": "저작재산권 양도동의서", "공공.pdf": "공공저작물 자유이용허락 동의서", "Public": "공공저작물 자유이용허락 동의서"}
    texts = {"용역 계약 조건": "계약서", "수집에 동의 합니다": "동의서", "권리 양도": "저작재산권 양도동의서", "public notice": "공공저작물 자유이용허락 동의서", "안내": "기타문서"}
    rows = spark.createDataFrame([(n, "", w) for n, w in names.items()] + [("scan", t, w) for t, w in texts.items()], "name string, content string, want string")
    assert rows.filter(C.detect_document_type(F.col("name"), F.col("content")) != F.col("want")).count() == 0
    titles = {"저작재산권 양도동의서": "저작재산권 양도동의서", "copyright transfer": "저작재산권 양도동의서", "transfer consent": "저작재산권 양도동의서", "Copyright Transfer Form": "기타문서", "public copyright": "공공저작물 자유이용허락 동의서", "공공누리": "공공저작물 자유이용허락 동의서", "agreement": "계약서", "계약": "기타문서", "a consent": "동의서", "동의": "기타문서"}
    rows = spark.createDataFrame(list(titles.items()), "title string, want string")
    assert rows.filter(C.document_type_from_title(F.col("title")) != F.col("want")).count() == 0
    files = {"양도_1.pdf": "copyright", "저작권": "copyright", "동의.pdf": "general", "계약.pdf": "general", "동의서": "consent", "Agreement": "contract"}
    rows = spark.createDataFrame(list(files.items()), "name string, want string")
    assert rows.filter(C.category_from_filename(F.col("name")) != F.col("want")).count() == 0
    kinds = {"Copyright Transfer Consent": "copyright_transfer", "양도동의": "copyright_transfer", "자유이용허락": "public_copyright", "계약": "general_enhanced", "Contract": "contract_enhanced", "동의서": "consent_enhanced"}
    rows = spark.createDataFrame(list(kinds.items()), "kind string, want string")
    assert rows.filter(C.schema_for_document_type(F.col("kind")) != F.col("want")).count() == 0


def test_record_names_and_nested_trims(spark):
    rows = spark.createDataFrame([("/a/b.txt", 0, False), ("/a/c.txt", 1, True)], "path string, i int, several boolean")
    assert [r[0] for r in rows.select(metadata.record_name(F.col("path"), F.col("i"), F.col("several"))).collect()] == ["b", "c__01"]
    df = spark.sql("SELECT named_struct('work_title', ' x ', 'n', 1) AS work_info, named_struct('work_names', array(' a', 'b ')) AS work_display, ' u ' AS user")
    got = T.trim_record_fields(df).first()
    assert (got.work_info.work_title, got.work_info.n, list(got.work_display.work_names), got.user) == ("x", 1, ["a", "b"], "u")


def test_pages_of_broken_documents_have_an_error(spark):
    def load():
        def pages(content):
            if content == b"bad":
                raise ValueError("no pages")
            return [content, content]

        return pages

    files = spark.createDataFrame([("a", b"ok"), ("b", b"bad")], "path string, content binary")
    got = sorted((r.doc_id, r.page_number, r.error) for r in models.read_pages_of(files, load).collect())
    assert got == [("a", 1, None), ("a", 2, None), ("b", 0, "ValueError: no pages")]


def test_answers_are_read_by_names_and_not_by_parsed_paths(spark):
    # a path that is no literal is parsed for every row
    df = spark.createDataFrame([("contract", "{}")], "schema string, metadata string")
    plan = records.validate_answers(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "concat($." not in plan


def test_answers_by_schema(spark):
    rows = [(1, "contract", '{"contract_type": "x", "rights_holder": "y", "user": "z", "payment_amount": "7", "parties": [{"name": "a"}, {}, 5], "granted_rights": {"rental_right": 1}}'), (2, "contract", "no json"), (3, "other", "{}"), (4, "general", None), (5, "general", '{"document_type": null, "title": "", "parties": {}}')]
    got = {r.i: (r._validation_errors, r.completeness) for r in records.validate_answers(spark.createDataFrame(rows, "i int, schema string, metadata string")).collect()}
    assert got[1] == (["granted_rights.rental_right: is not of type boolean", "parties/1/name: is required", "parties/2/name: is required", "payment_amount: is not of type number"], 6 / 18)
    assert got[2] == (["contract_type: is required", "rights_holder: is required", "user: is required"], 0.0)
    assert got[3] == (None, None) and got[4][0] == ["document_type: is required", "title: is required"]
    assert got[5] == (["document_type: is required", "parties: is not of type array"], 1 / 9)


def test_the_grammar_fills_every_type_and_labels_what_it_wrote(spark):
    ids = spark.range(3000)
    rows = grammar.synthesize_varied_corpus(ids).collect()
    assert len(grammar.VALUES) == 23 and {e.type for r in rows for e in r.entities} == set(grammar.VALUES)
    assert 1500 < len(rows) <= 3000 and len({e.value for r in rows for e in r.entities}) > 5000
    for r in rows:
        assert len(r.labels) == len(r.text) and "{" not in r.text and "<" not in r.text
        want = ["O"] * len(r.text)
        for e in r.entities:
            assert r.text[e.start : e.start + len(e.value)] == e.value
            for k, c in enumerate(e.value):
                want[e.start + k] = "O" if c == " " else ("B-" if k == 0 else "I-") + e.type
        assert r.labels == want and len(r.entities) >= 3 and len({e.type for e in r.entities}) >= 2
    assert any(len([e for e in r.entities if e.type == "COMPANY"]) > 1 for r in rows)
    again = grammar.synthesize_varied_corpus(ids.filter("id % 7 = 3").repartition(3)).collect()
    assert {r.id: r for r in again} == {r.id: r for r in rows if r.id % 7 == 3}
    odd = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id long, text string")
    assert len({r.text for r in grammar.synthesize_varied_corpus(odd).collect()}) <= 1
    assert grammar.synthesize_varied_corpus(spark.range(0)).count() == 0


def test_the_grammar_fills_the_slots_of_many_texts_at_once(spark):
    made = grammar.synthesize_varied_corpus(spark.range(50))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("md5(") < 20  # of the texts alone; a pick for each pattern before
    df = spark.createDataFrame([("42/1", ["{NAME}", " 및 ", "{NAME}"]), ("42/2", []), ("42/3", ["글 x"])], "key string, slots array<string>")
    rows = [r.made for r in df.coalesce(1).select(grammar.fill_slots("key", "slots").alias("made")).collect()]
    part = lambda i, n, pool: grammar.PARTS[pool][int(hashlib.md5(f"42/1/{i}/{n}".encode()).hexdigest()[:8], 16) % len(grammar.PARTS[pool])]
    names = [part(i, 0, "family") + part(i, 1, "given") for i in (0, 2)]
    assert rows[0].text == " 및 ".join(names) and [(e.value, e.start) for e in rows[0].entities] == [(names[0], 0), (names[1], 6)]
    assert rows[0].labels == ["B-NAME", "I-NAME", "I-NAME", "O", "O", "O", "B-NAME", "I-NAME", "I-NAME"]
    assert (rows[1].text, rows[1].entities, rows[1].labels) == ("", [], []) and (rows[2].text, rows[2].labels) == ("글 x", ["O"] * 3)


def test_prompts_are_sent_once_and_answers_cleaned_once(spark):
    """All providers are asked in one pass, and one that nothing is asked of is not loaded; the plan has each pattern once."""

    def none():
        raise RuntimeError("loaded")

    df = docs(spark, "text", None).withColumn("document_type", F.lit("general"))
    out = models.extract_with_model(df, "{}", [("first", lambda: lambda prompt: 'x\n```json\n{"a": 1}\n```'), ("second", none)])
    assert [(r.model_used, r.metadata, r.error) for r in out.collect()] == [("first", '{"a": 1}', None)]
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("LogicalRDD") == 1 and "prompt" not in plan.toString()
    assert plan.expressions().toString().count("```[a-zA-Z]*") == 1


def test_spans_of_both_labels_are_counted_in_one_pass(spark):
    kinds, at = ["O", "B-A", "I-A", "B-B", "I-B"], lambda i, k: hashlib.md5(f"{i}/{k}".encode()).digest()
    rows = [(i, k, k * 3, k * 3 + 2, kinds[at(i, k)[0] % 5], kinds[at(i, k)[at(i, k)[1] % 3 and 0 or 2] % 5], 1.0) for i in range(200) for k in range(i % 9)]
    t = spark.createDataFrame([*rows, (900, 0, 0, 0, "B-A", "B-A", 1.0)], "sent_id int, pos int, start int, end int, gold string, pred string, confidence double")
    gold, pred = (sequence.decode_bio(t.withColumn("label", F.col(c)), mode="lenient") for c in ("gold", "pred"))
    counts = evaluate.count_label_spans(t)
    assert evaluate.evaluate_counts(counts).collect() == evaluate.evaluate_entities(gold, pred).collect() and evaluate.evaluate_counts(counts).first().tp > 50
    assert sorted(evaluate.evaluate_counts_by_type(counts, t).collect()) == sorted(evaluate.evaluate_by_type(gold, pred, t).collect())
    assert evaluate.evaluate_counts(evaluate.count_label_spans(t.limit(0))).first().n_gold == 0
    plan = catalog.QUERIES["evaluate_entities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("posexplode") == 1 and "Join" not in plan  # the words are made and sorted once
