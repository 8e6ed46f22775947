"""Contracts, consents, OCR words, model answers and labelled tokens rendered from the driver tables.

Each text is one SQL string that Spark and DuckDB both read, so queries and the SQL they are held against begin with the same
rows, which grow with the tables.  All names and numbers are made up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tables whose rows are spread by a key before texts are made of them.
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id"}
#: The join of DOCUMENTS, which comes before rows are spread: a join that shuffles would undo it.
JOIN = "orders JOIN customer ON o_custkey = c_custkey"
#: Texts in which the column ``text`` is most of the work.
LONG = ("AS text\nFROM orders JOIN", "AS text\nFROM (SELECT c_custkey AS o_orderkey", "AS text\nFROM customer")
TABLES = ("orders", "customer", "lineitem", "documents", "events", "part", "supplier")


def _pick(key: str, *values: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _pad(x: str, n: int) -> str:
    return f"lpad({_s(x)}, {n}, '0')"


K = "o_orderkey"
NL = "chr(10)"
_NAME = _pick(K, "김하늘", "이바다", "박구름", "최나무", "정가람", "한누리", "윤슬")
_NAME2 = _pick(K, "오로라", "서리나", "문새벽", "강여울", "조약돌")
_COMPANY = _pick(K, "가온출판사", "누리연구소", "다솜문화재단", "라온방송센터")
_PHONE = f"'010-' || {_pad(f'{K} % 9000 + 1000', 4)} || '-' || {_pad(f'{K} % 10000', 4)}"
_DATE = f"{_s(f'2000 + {K} % 30')} || '년 ' || {_s(f'1 + {K} % 12')} || '월 ' || {_s(f'1 + {K} % 28')} || '일'"
_DATE2 = f"{_s(f'2001 + {K} % 30')} || '-' || {_pad(f'1 + {K} % 11', 2)} || '-' || {_pad(f'1 + {K} % 27', 2)}"
_ADDRESS = f"{_pick(K, '서울시 종로구 새길 ', '부산시 해운대구 바닷길 ', '경기도 가평군 숲속로 ')} || {_s(f'1 + {K} % 99')}"
_RID = f"{_pad(f'800101 + {K} % 90', 6)} || '-' || {_pad(f'1000000 + {K} % 1000', 7)}"
_AMOUNT = f"{_s(f'1 + {K} % 9')} || ',' || {_pad(f'{K} % 1000', 3)} || ',000원'"
_BOX = lambda i: f"CASE ({K} + {i}) % 4 WHEN 0 THEN '☑' WHEN 1 THEN '□' WHEN 2 THEN '📧 ' ELSE '☐' END"

_CONTRACT = f" || {NL} || ".join(
    [
        "'저작재산권 양도 계약서'",
        f"'갑: ' || {_COMPANY} || ' (130-81-' || {_pad(f'{K} % 100000', 5)} || ')'",
        f"'을: ' || {_NAME} || ', 담당 ' || {_NAME2} || ' 과장'",
        "'제1조(목적) 이 계약은 저작물의 이용에 관한 것이다. 제2조 이용허락 범위'",
        f"CASE WHEN {K} % 7 = 0 THEN '주민등록번호: ' || {_RID} ELSE '생년월일 생략' END",
        f"'저작물명: 국립극장<작품 ' || {_s(K)} || '> ○'",
        f"'대상 저작물 상세정보: 무대 사진 ' || {_s(f'{K} % 50')} || '점 □'",
        f"'양수자 기관명: ' || {_COMPANY}",
        f"'양도자 소속: ' || {_COMPANY} || ' 기획부'",
        f"'양도자 주소: ' || {_ADDRESS}",
        f"'양도자 연락처: ' || {_PHONE}",
        f"'이메일 user' || {_s(K)} || '@example.com'",
        f"CASE WHEN {K} % 6 = 0 THEN '기간 미정' WHEN {K} % 6 = 1 THEN '계약일: ' || {_DATE} ELSE '기간 ' || {_DATE} || ' ~ ' || {_DATE2} END",
        f"CASE WHEN {K} % 5 = 0 THEN '금액 협의' ELSE '계약금: ' || {_AMOUNT} END",
        f"'허락 권리: ' || {_BOX(0)} || '복제권 ' || {_BOX(1)} || '공연권 ' || {_BOX(2)} || '공중송신권 ' || {_BOX(3)} || '공면권 ' || {_BOX(4)} || '비독점적'",
        f"{_BOX(5)} || '제1유형 ' || {_BOX(6)} || '제2유형 ' || {_BOX(7)} || '제3유형 변경 가능'",
        f"CASE WHEN {K} % 4 = 0 THEN '끝' ELSE '서명 또는 날인' END",
    ]
)
_SUBJECT = f"'성명: ' || {_NAME} || {NL} || '주소: ' || {_ADDRESS} || {NL} || '전화번호: ' || {_PHONE} || {NL} || '동의날짜 ' || {_DATE}"
_CONSENT = f" || {NL} || ".join(
    [
        "'개인정보 수집·이용 동의서'",
        f"CASE WHEN {K} % 11 = 0 THEN '대상자 없음' ELSE {_SUBJECT} END",
        f"CASE WHEN {K} % 3 = 0 THEN '성명: ' || {_NAME2} || {NL} || '날짜: ' || {_DATE2} ELSE '본인 확인' END",
        f"'기관명: ' || {_COMPANY} || {NL} || '대표자명: ' || {_NAME2}",
        f"{_BOX(1)} || '서비스제공 ' || {_BOX(2)} || '마케팅 ' || {_BOX(3)} || '제3자제공동의'",
        f"'동의 여부: ' || {_pick(K, '동의함', '동의하지 않음')}",
        f"CASE WHEN {K} % 2 = 0 THEN '서명란' ELSE '확인' END",
    ]
)

#: (doc_id, path, text)
DOCUMENTS = f"""
SELECT o_orderkey AS doc_id,
       '/srv/data/' || {_pick(K, '계약서', 'consent', 'scan', 'copyright')} || '/' || {_s(f'{K} % 50')} || '/' || {_pick(K, 'contract', '동의', 'agreement_양도', 'paper', '공공')} || {_s(K)} || '.txt' AS path,
       CASE WHEN {K} % 97 = 0 THEN CAST(NULL AS STRING) WHEN {K} % 5 < 3 THEN {_CONTRACT} ELSE {_CONSENT} END AS text
FROM orders JOIN customer ON o_custkey = c_custkey
"""
#: (doc_id, name, title, content, kind): file names, titles, contents and types that reach every branch of the classifiers
TITLES = f"""
SELECT o_orderkey AS doc_id,
       {_pick(K, "용역계약서.pdf", "Contract_7.PDF", "동의서.txt", "CONSENT-2.txt", "양도_1.pdf", "transfer form.pdf", "공공저작.pdf", "Public work.pdf", "저작권.hwp", "copyright.tif", "agreement.doc", "scan.tif", "계약_3.pdf")} AS name,
       nullif({_pick(K, "저작재산권 양도동의서", "copyright transfer form", "a transfer consent", "Copyright Transfer Form", "공공저작물 자유이용허락 동의서", "공공누리 안내", "public copyright terms", "용역 계약서", "sales contract", "an agreement", "개인정보 동의서", "a consent", "계약 조건", "저작재산권 양도", "공공저작물 목록", "", "Consent")}, '') AS title,
       {_pick(K, "용역 계약 조건", "수집에 동의 합니다", "권리를 양도 함", "Transfer of works", "공공 자료", "PUBLIC notice", "안내문")} AS content,
       {_pick(K, "저작재산권 양도동의서", "Copyright Transfer Consent", "양도동의", "Transfer Consent form", "공공저작물 자유이용허락 동의서", "Public Copyright", "자유이용허락", "공공누리", "계약서", "Contract", "동의서", "CONSENT", "기타문서", "계약", "동의", "공공저작물")} AS kind
FROM orders
"""
#: (doc_id, page_number, y, x, text, confidence)
WORDS = """
SELECT l_orderkey AS doc_id, CAST(1 + l_suppkey % 2 AS INT) AS page_number, CAST(l_linenumber * 13 + l_partkey % 9 AS DOUBLE) AS y, CAST(l_suppkey % 1000 AS DOUBLE) AS x,
       'w' || CAST(l_partkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS text, CASE WHEN l_linenumber = 3 THEN NULL ELSE 1 - l_discount END AS confidence
FROM lineitem
"""
#: (doc_id, page_number, provider, extracted_text, status)
PAGES = """
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS page_number, p.provider, CASE WHEN l_partkey % 9 = p.k THEN '' ELSE p.provider || repeat('글 ', CAST((l_partkey + p.k * 5) % 7 AS INT)) END AS extracted_text,
       CASE WHEN l_partkey % 9 = p.k THEN 'failed' ELSE 'success' END AS status
FROM lineitem CROSS JOIN (SELECT 'google' AS provider, 0 AS k UNION ALL SELECT 'mistral', 1 UNION ALL SELECT 'naver', 2) p
"""
#: (sent_id, word): the words of the documents, from which tokens follow by position
LABEL = "CASE length(word) % 7 WHEN 0 THEN 'B-NAME' WHEN 1 THEN 'I-NAME' WHEN 2 THEN 'B-DATE' WHEN 3 THEN 'I-DATE' ELSE 'O' END"
#: (sent_id, pos, start, end, gold, pred, confidence); {words} has (sent_id, pos, word)
TOKENS = f"""
SELECT sent_id, CAST(pos AS INT) AS pos, CAST(pos * 10 AS INT) AS start, CAST(pos * 10 + 5 AS INT) AS "end", {LABEL} AS gold,
       CASE WHEN (sent_id + pos) % 11 = 0 THEN 'O' WHEN (sent_id + pos) % 13 = 0 THEN 'B-DATE' ELSE {LABEL} END AS pred, CAST((sent_id * 7 + pos * 3) % 100 AS DOUBLE) / 100 AS confidence
FROM ({{words}}) w
"""
SPARK_WORDS = "SELECT doc_id AS sent_id, pos, word FROM documents LATERAL VIEW posexplode(split(text, ' ')) t AS pos, word"
DUCK_WORDS = "SELECT doc_id AS sent_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"
#: (call_id, ts, provider, text, latency, is_error)
CALLS = """
SELECT event_id AS call_id, ts, CASE event_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'local' END AS provider, props AS text, value AS latency, event_id % 17 = 0 AS is_error FROM events
"""
#: (doc_id, response)
RESPONSES = f"""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 6
  WHEN 0 THEN '{{{{"user": "' || {_NAME} || '"}}}}' WHEN 1 THEN 'Here: ' || chr(10) || '```json' || chr(10) || '{{{{"user": "' || {_NAME} || '", "amount": "1,000"}}}}' || chr(10) || '```'
  WHEN 2 THEN 'no object' WHEN 3 THEN 'text {{{{"a": 1}}}} and more' WHEN 4 THEN '{{{{"broken": ' ELSE '' END AS response
FROM orders
""".replace("{{", "{").replace("}}", "}")


#: (doc_id, text, company, name, role, date): sentences with values that hold one another, and the values
SENTENCES = f"""
SELECT doc_id, company || ' 소속 ' || name || ' ' || role || ', ' || date || ' ' || company || ' 계약 ' || name || role AS text, company, name, role, date
FROM (SELECT o_orderkey AS doc_id, {_COMPANY} AS company, {_NAME} AS name, {_pick(K, "과장", "대리", "부장")} AS role, {_DATE} AS date FROM orders)
"""
#: (doc_id, schema, text): answers of a model as text, with gaps, wrong types and values, for the eight schemas in turn
_KC = "c_custkey"
_SOMETIMES = lambda n, text, other="": f"CASE WHEN {_KC} % {n} = 0 THEN '{other}' ELSE '{text}' END"
ANSWERS = f"""
SELECT c_custkey AS doc_id, {_pick(f"CAST(floor(c_custkey / 11) AS BIGINT)", "contract", "contract_enhanced", "consent", "consent_enhanced", "general", "general_enhanced", "copyright_transfer", "public_copyright")} AS schema,
  '{{"document_type": ' || {_SOMETIMES(3, '"x"', 'null')} || ', "title": ""' || ', "contract_type": ' || {_SOMETIMES(4, '"매매"', '7')} || ', "rights_holder": "가온"' || {_SOMETIMES(5, ', "user": "나래"')}
  || ', "consent_type": "수집", "data_controller": "기관", "consent_status": ' || {_pick(_KC, '"동의함"', '"거부"', '"null"')} || ', "payment_amount": ' || {_SOMETIMES(13, '1000', '"1000"')}
  || ', "granted_rights": ' || {_SOMETIMES(6, '{"reproduction_right": true}', '[]')} || ', "work_info": {{"work_title": ' || {_SOMETIMES(7, '"작품"', 'null')} || ', "work_type": ' || {_SOMETIMES(2, '"도서"', '"조각"')} || '}}'
  || ', "work_display": {{"work_names": ' || {_SOMETIMES(9, '["가"]', '"가"')} || '}}, "parties": [{{"name": "가", "role": "저작자"}}, {{"name": ' || {_SOMETIMES(8, '"나"', 'null')} || ', "role": "친구"}}]'
  || ', "checkbox_info": {{"pattern_detected": ' || {_SOMETIMES(10, '"pattern_a"', '"pattern_x"')} || ', "extraction_confidence": ' || {_SOMETIMES(12, '0.5', '1.5')} || '}}'
  || ', "confidence": ' || {_SOMETIMES(12, '0.5', '1.5')} || '}}' AS text
FROM customer
""".replace("{{", "{").replace("}}", "}")


def view(spark: SparkSession, sf_dir: str, sql: str, parts: int | None = None, copies: bool = False) -> DataFrame:
    """The rows of a rendered text over the tables of a folder.

    Texts are far larger than the rows they are made of, so these rows are spread by their key before they are rendered: a
    table may be a few large row groups.  The number of partitions is given, as adaptive execution would join partitions by the
    size of the rows and not of the texts.  A long text is rendered once for a row: the generator keeps the optimizer from
    rendering it again in a filter that moves down.  With ``copies`` the rows of orders and customers also have the number of rows
    of their key, counted where the key is and before the text is there.
    """
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    long = any(end in sql for end in LONG)
    if JOIN in sql:
        joined = table("orders").join(table("customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        joined = joined.repartition(parts, KEYS["orders"])
        if copies:
            joined = joined.withColumn("copies", F.count(F.lit(1)).over(W.partitionBy(KEYS["orders"])))
            sql = sql.replace(f"SELECT {KEYS['orders']} AS doc_id", f"SELECT {KEYS['orders']} AS doc_id, copies")
        joined.createOrReplaceTempView("joined_orders")
        sql = sql.replace(JOIN, "joined_orders")
    for name in TABLES:
        if name in sql.replace("joined_orders", ""):
            rows = table(name)
            (rows.repartition(parts, KEYS[name]) if name in KEYS else rows).createOrReplaceTempView(name)
    rows = spark.sql(sql.replace('"end"', "`end`"))
    return rows.select(*[F.explode(F.array(c)).alias(c) if c == "text" else c for c in rows.columns]) if long else rows


def tokens(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return view(spark, sf_dir, TOKENS.format(words=SPARK_WORDS), parts)


def parts_of_text(spark: SparkSession, sf_dir: str, size: int = 1 << 21) -> int:
    """Partitions for ``documents`` so that one has about ``size`` bytes of text, the usual number at least."""
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text // size))


DUCK_TOKENS = TOKENS.format(words=DUCK_WORDS)
