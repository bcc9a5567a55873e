"""Text function queries, on driver tables where these have what the function looks at, else on examples of our own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.functions import terms as D
from quillspark.functions import text as X
from quillspark.functions.terms import ALIASES, INTENT_TERMS, QUESTION_PARTICLES, STOP_TERMS, TEXT_PARTICLES
from quillspark.functions.unicode import normal_form
from quillspark.operators import spelling
from quillspark.queries.common import bm25_top, literal, planted, sql_bm25, sql_planted, sql_sentences, sql_tokens, table, values

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


ASK = [
    (1, "수혈  전에 확인할 사항을 알려주세요"),
    (2, "흉강천자 절차와 PCN irrigation 준비물은 무엇인가요"),
    (3, "Foley catheter 관리 방법"),
    (4, "격리 해제 기준이란"),
    (5, "산소 투여 중 관찰 항목에서는"),
    (6, "오늘 날씨 어때"),
    (7, "VRE 격리와 CRE 격리의 차이"),
    (8, "말초삽입 중심정맥관 소독 순서"),
    (9, "욕창간호 목적"),
    (10, "시술 후 활력징후를 요약해줘"),
]
SCHEMA = "id long, q string"
VALUES = f"q AS (SELECT id::BIGINT AS id, q FROM {values(ASK, 'id, q')})"
_LOW = "lower(trim(regexp_replace(q, '\\s+', ' ', 'g')))"


def ask(spark):
    return literal(spark, ASK, SCHEMA)


@query("n01_clean", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents")
def n01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean(F.col("text")).alias("clean"))


@query("n02_compatibility_form")
def n02(spark, sf):
    return literal(spark, [(1, "ＶＲＥ ①"), (2, "ｶﾀｶﾅ ㎎"), (3, "plain")], SCHEMA).select("id", normal_form("NFKC")("q").alias("q"))


@query("n02_document_forms")
def n02_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normal_form("NFKC")("text").alias("text"))


# The words of the conversations, some with a letter dropped or doubled, against those of the documents.
@query("n11_spelling")
def n11(spark, sf):
    words = lambda name: table(spark, sf, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct()
    w, part = F.col("w"), F.crc32("w") % 5
    typed = F.when(part == 0, F.concat(F.substring(w, 1, 2), F.substring(w, 4, 1000))).when(part == 1, F.concat(F.substring(w, 1, 3), F.substring(w, 3, 1000))).otherwise(w)
    return spelling.corrections(words("conversations").select(typed.alias("w")), words("documents"))


@query("n03_lexical_tokens", f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents) GROUP BY ALL")
def n03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.lexical_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


_HANGUL = "regexp_full_match(w, '[가-힣]+')"


@query(
    "n03_lexical_tokens_korean",
    f"""WITH {VALUES}, w AS (SELECT id, unnest({sql_tokens('q')}) AS w FROM q),
b AS (SELECT id, CASE WHEN NOT {_HANGUL} THEN w WHEN regexp_replace(w, '(?:{TEXT_PARTICLES})$', '') = '' THEN w ELSE regexp_replace(w, '(?:{TEXT_PARTICLES})$', '') END AS token FROM w
UNION ALL SELECT id, 'ko:' || substring(w, i::INT, 2) FROM (SELECT id, w, unnest(range(1, length(w))) AS i FROM w WHERE {_HANGUL}))
SELECT id, token, count(*) AS tf FROM b GROUP BY ALL""",
)
def n03k(spark, sf):
    return ask(spark).select("id", F.explode(X.lexical_tokens(F.col("q"), entities=False)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


_LIST = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"


@query(
    "n04_query_terms",
    f"""WITH w AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT item_id, {sql_tokens('text')} AS t FROM benchmark)),
f AS (SELECT item_id, w AS term, min(i) AS i FROM w WHERE length(w) > 1 GROUP BY ALL)
SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY i) AS position FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i) <= 32""",
)
def n04(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.posexplode(X.query_terms(F.col("text"))).alias("position", "term")).select("item_id", "term", (F.col("position") + 1).cast("long").alias("position"))


@query(
    "n04_query_terms_korean",
    f"""WITH {VALUES}, w AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT id, {sql_tokens('q')} AS t FROM q)),
b AS (SELECT id, i, CASE WHEN {_HANGUL} AND w NOT IN {_LIST(INTENT_TERMS)} AND length(regexp_replace(w, '(?:{QUESTION_PARTICLES})$', '')) >= 2 THEN regexp_replace(w, '(?:{QUESTION_PARTICLES})$', '') ELSE w END AS term FROM w WHERE w NOT IN {_LIST(STOP_TERMS)})
SELECT id, term, min(i) > 0 AS present FROM b WHERE id IN (1, 4, 5, 6, 9, 10) AND length(term) > 1 GROUP BY ALL""",
)
def n04k(spark, sf):
    return ask(spark).filter(F.col("id").isin(1, 4, 5, 6, 9, 10)).select("id", F.explode(X.query_terms(F.col("q"))).alias("term")).distinct().withColumn("present", F.lit(True))


@query("n05_minimal_tokens", f"SELECT doc_id, len({sql_tokens('text', '[a-z][a-z0-9-]*|[가-힣]+|[0-9]+(?:\\.[0-9]+)?')})::BIGINT AS n FROM documents")
def n05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.minimal_tokens(F.col("text"))).cast("long").alias("n"))


@query("n06_common_query")
def n06(spark, sf):
    return planted(spark, sf, ASK).select("id", F.array_join(X.query_terms(X.split_attached_aspects(F.col("q"))), " ").alias("common"))


_UNIT = "[0-9]+(?:\\.[0-9]+)?\\s*(?:mg|ml|kg|%)?"


@query(
    "n07_table_tokens",
    """WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_size) AS s FROM part),
w AS (SELECT p_partkey, unnest(regexp_extract_all(s, '[a-z][a-z0-9-]*|[가-힣]{2,}')) AS token FROM t UNION ALL SELECT p_partkey, replace(unnest(regexp_extract_all(s, '[0-9]+(?:\\.[0-9]+)?\\s*(?:mg|ml|kg|%)?')), ' ', '') FROM t)
SELECT p_partkey, token, count(*) AS tf, CASE WHEN regexp_matches(token, '^[0-9]') THEN 10.0 ELSE 1.0 END::DOUBLE AS weight FROM w GROUP BY ALL""",
)
def n07(spark, sf):
    s = F.lower(F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")))
    numbers = F.transform(F.regexp_extract_all(s, F.lit(_UNIT), F.lit(0)), lambda x: F.replace(x, F.lit(" "), F.lit("")))
    tokens = F.concat(X.lexical_tokens(s), numbers)
    return table(spark, sf, "part").select("p_partkey", F.explode(tokens).alias("token")).groupBy("p_partkey", "token").agg(F.count("*").alias("tf")).withColumn("weight", F.when(F.col("token").rlike("^[0-9]"), 10.0).when(F.col("token").startswith("ko:"), 0.25).otherwise(1.0))


@query(
    "n08_term_match",
    "WITH w AS (SELECT unnest(['license', 'apache', 'token', 'the', 'idiot']) AS word) SELECT word, count(*) FILTER (regexp_matches(lower(text), '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)')) AS matches FROM w, documents GROUP BY 1",
)
def n08(spark, sf):
    words = ("license", "apache", "token", "the", "idiot")
    counts = table(spark, sf, "documents").agg(*[F.count_if(X.term_matches(F.lit(w), F.col("text"))).alias(w) for w in words])
    return counts.unpivot([], list(words), "word", "matches")


def sql_anchors(text: str) -> str:
    """The anchors of a text, comma-joined: what an alias matches is blanked before the next, the longest first."""
    aliases = sorted(((k, a) for k, own in ALIASES.items() for a in own), key=lambda x: -len(x[1]))
    patterns = [(k, f"(^|[^a-z0-9]){a}($|[^a-z0-9])" if a.isascii() else "\\s*".join(a.replace(" ", ""))) for k, a in aliases]
    rest, found = "split_part(acc, '#', 1)", "split_part(acc, '#', 2)"
    key, pattern = "split_part(x, '#', 1)", "split_part(x, '#', 2)"
    more = f"{found} || CASE WHEN contains(',' || {found} || ',', ',' || {key} || ',') THEN '' WHEN {found} = '' THEN {key} ELSE ',' || {key} END"
    start = f"replace(lower(trim(regexp_replace({text}, '\\s+', ' ', 'g'))), '#', ' ') || '#'"
    return f"split_part(list_reduce([{', '.join(repr(f'{k}#{p}').replace(chr(92) * 2, chr(92)) for k, p in patterns)}], lambda acc, x: CASE WHEN regexp_matches({rest}, {pattern}) THEN regexp_replace({rest}, {pattern}, ' ', 'g') || '#' || {more} ELSE acc END, {start}), '#', 2)"


@query("n09_anchors", f"WITH q AS {sql_planted(ASK)} SELECT id, {sql_anchors('q')} AS anchors FROM q")
def n09(spark, sf):
    return planted(spark, sf, ASK).select("id", F.array_join(X.anchors(F.col("q")), ",").alias("anchors"))


_OTHERS = [(1, "VRE 격리 지침"), (2, "폴리 카테터 교환")]


@query("n10_compatible", f"WITH q AS {sql_planted(ASK)}, a AS (SELECT id, {sql_anchors('q')} AS wanted FROM q), o AS {values(_OTHERS, 'tid, t')}, b AS (SELECT tid::BIGINT AS tid, {sql_anchors('t')} AS held FROM o) SELECT id, tid, wanted = '' OR list_has_any(string_split(wanted, ','), string_split(held, ',')) AS compatible FROM a, b")
def n10(spark, sf):
    other = literal(spark, _OTHERS, "tid long, t string")
    return planted(spark, sf, ASK).join(F.broadcast(other)).select("id", "tid", X.compatible(F.col("q"), F.col("t")).alias("compatible"))  # by two rows


_ASPECT = [(1, "욕창간호절차 알려줘"), (2, "수혈준비사항은"), (3, "격리 목적"), (4, "도뇨관리주의사항을 정리")]


@query("n12_attached_aspects")
def n12(spark, sf):
    return literal(spark, _ASPECT, SCHEMA).select("id", X.split_attached_aspects(F.col("q")).alias("q"))


@query("n12_turn_aspects")
def n12_turns(spark, sf):
    return planted(spark, sf, _ASPECT).select("id", X.split_attached_aspects(F.col("q")).alias("q"))


@query(
    "n13_substantive_body",
    """WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND x <> source AND NOT regexp_full_match(x, '(?:\\[[^\\]]{1,50}\\]|(?:예시|그림|표)\\s*[①-⑳\\d]+)')) AS ls FROM documents)
SELECT doc_id, length(array_to_string(ls, ' ')) >= 8 AND regexp_matches(array_to_string(ls, ' '), '[가-힣a-zA-Z]') AS substantive FROM l""",
)
def n13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.substantive_body(F.col("text"), F.array("source")).alias("substantive"))


_PRIVATE = [(1, "환자번호: 12345678"), (2, "연락처 010-1234-5678"), (3, "900101-1234567"), (4, "병실 번호: 302"), (5, "수혈 전 확인"), (6, "MRN 00012"), (7, "환자 이름: 홍길동")]


@query("n14_private_guard", f"WITH q AS {sql_planted(_PRIVATE)} SELECT id::BIGINT AS id, regexp_matches(q, '(^|[^0-9])[0-9]{{6}}\\s*[-–]?\\s*[1-8][0-9]{{6}}([^0-9]|$)|(^|[^0-9])01[016789][ -]?[0-9]{{3,4}}[ -]?[0-9]{{4}}([^0-9]|$)|(?:환자\\s*(?:등록)?번호|등록번호|차트번호|[Mm][Rr][Nn])\\s*[:：#]?\\s*[0-9]{{4,}}|(?:환자\\s*(?:성명|이름)|환자명)\\s*[:：]\\s*[가-힣]{{2,5}}|병실\\s*번호\\s*[:：#]\\s*[0-9]{{2,}}') AS private FROM q")
def n14(spark, sf):
    return planted(spark, sf, _PRIVATE).select("id", X.looks_private(F.col("q")).alias("private"))


@query("n15_identifier_types", "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]') THEN 'email' END, CASE WHEN regexp_matches(text, '\\+[0-9]{1,3} \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}') THEN 'phone' END, CASE WHEN regexp_matches(text, '[0-9]{6}-[1-8][0-9]{6}') THEN 'resident' END) AS types FROM documents")
def n15(spark, sf):
    t = F.col("text")
    found = F.array_compact(F.array(F.when(t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"), F.lit("email")), F.when(t.rlike(r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"), F.lit("phone")), F.when(t.rlike("[0-9]{6}-[1-8][0-9]{6}"), F.lit("resident"))))
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("types"))


_LINES = [(1, "1. 준비 단계"), (2, "목적"), (3, "환자를 확인한다."), (4, "Ⅱ. 절차"), (5, "가) 소독 범위"), (6, "1.2) 세척 순서"), (7, "손 위생을 시행한다"), (8, "시행 방법"), (9, "2. 이 항목은 아주 길어서 제목이 될 수 없는 문장이며 예순 글자를 넘기도록 계속해서 이어서 적어 둔 예시 줄로 끝까지 남긴 글입니다 참고"), (10, "용량 10 mg"), (11, "병동 | 담당"), (12, "간호부")]
_PL = f"l AS {sql_planted(_LINES, 'chr(10)')}"


@query("n16_heading", f"WITH {_PL} SELECT id, length(trim(q)) <= 60 AND NOT regexp_matches(trim(q), '(?:다[.!?]?|[。.!?])$') AND (regexp_matches(trim(q), '^(?:\\d+(?:\\.\\d+)*[.)]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[. ]|[가-하]\\))\\s*\\S') OR trim(q) IN ('목적', '준비물', '주의사항', '적응증', '금기', '시행 방법', '절차')) AS heading FROM l")
def n16(spark, sf):
    return planted(spark, sf, _LINES, "\n").select("id", X.looks_like_heading(F.col("q")).alias("heading"))


@query("n17_running_header_shape", f"WITH {_PL} SELECT id, length(q) BETWEEN 1 AND 60 AND len(string_split(q, chr(10))) <= 2 AND NOT regexp_matches(q, '(?:다[.!?]?|[.!?])$') AS shape FROM l")
def n17(spark, sf):
    return planted(spark, sf, _LINES, "\n").select("id", X.looks_like_running_header(F.col("q")).alias("shape"))


@query("n18_page_label", f"WITH {_PL} SELECT id, length(q) BETWEEN 1 AND 60 AND NOT contains(q, ' | ') AND NOT regexp_matches(q, '(?:다[.!?]?|[。.!?])$') AND NOT regexp_matches(q, '(?i)\\d\\s*(?:mg|ml|㎎|㎖|℃|분|시간|회|%)') AND regexp_matches(q, '[가-힣A-Za-z]') AS candidate FROM l")
def n18(spark, sf):
    return planted(spark, sf, _LINES, "\n").select("id", X.page_label_candidate(F.col("q")).alias("candidate"))


_PHASE = [(1, "시술 전 확인"), (2, "수혈 중 관찰"), (3, "검사 후에 보고"), (4, "사전 준비와 이후 관리"), (5, "회복 시 관찰"), (6, "투약 시 주의"), (7, "안전 관리"), (8, "수술하기 전"), (9, "시행하는 동안"), (10, "전·후 비교")]


@query("n19_temporal_phases")
def n19(spark, sf):
    return planted(spark, sf, _PHASE).select("id", F.array_join(X.temporal_phases(F.col("q")), ",").alias("phases"))


_N_LOW = "lower(trim(regexp_replace(q, '\\s+', ' ', 'g')))"
_N_PHASES = ", ".join(
    f"CASE WHEN regexp_matches({_N_LOW}, '(?:^|[^가-힣a-z0-9])(?:{'|'.join(A.PHASE_WORDS[p])})(?:[^가-힣a-z0-9]|$)') OR list_contains(list_concat({', '.join(f'regexp_extract_all({_N_LOW}, $${x}(?:{A.PHASE_END})$$, 1)' for x in (A.EVENT, A.CONTINUED))}), '{s}') THEN '{p}' END" for s, p in A.SHORT_PHASES.items()
)


@query("n20_unit_phases", f"WITH a AS {sql_planted(_PHASE)} SELECT id, concat_ws(',', {_N_PHASES}) AS phases FROM a")
def n20(spark, sf):
    return planted(spark, sf, _PHASE).select("id", F.array_join(A.unit_phases(F.col("q")), ",").alias("phases"))


FAMILIES = A.FAMILIES
_ACTS = [(1, "활력징후를 확인하고 기록한다"), (2, "이상 시 보고한다"), (3, "물품을 준비한다"), (4, "상태를 관찰하고 평가한다"), (5, "설명한다"), (6, "병실로 이동하여 산소를 연결한다"), (7, "서명을 받는다"), (8, "쉰다")]


@query("n21_action_families", f"WITH a AS {sql_planted(_ACTS)} SELECT id::BIGINT AS id, concat_ws(',', {', '.join('CASE WHEN ' + ' OR '.join(f'contains(q, $${r}$$)' for r in own) + f' THEN $${k}$$ END' for k, own in FAMILIES.items())}) AS families FROM a")
def n21(spark, sf):
    return planted(spark, sf, _ACTS).select("id", F.array_join(X.action_families(F.col("q"), FAMILIES), ",").alias("families"))


_BRANCH = [(1, "[성인] 5 mg 투여"), (2, "[소아] 체중 확인\n[성인] 제외"), (3, "성인: 앉은 자세"), (4, "자세를 확인한다"), (5, "[임부] 상담")]


@query("n22_branch_marker", f"WITH b AS {sql_planted(_BRANCH)} SELECT id::BIGINT AS id, CASE WHEN a AND p THEN 'common' WHEN a THEN 'adult' WHEN p THEN 'pediatric' WHEN o THEN 'explicit_other' ELSE 'common' END AS branch FROM (SELECT id, regexp_matches(q, '\\[성인\\]|(?m)^성인\\s*[:|]') AS a, regexp_matches(q, '\\[소아\\]|(?m)^소아\\s*[:|]') AS p, regexp_matches(q, '\\[[가-힣]+\\]') AS o FROM b)")
def n22(spark, sf):
    q = F.col("q")
    a, p = q.rlike(r"\[성인\]|(?m)^성인\s*[:|]"), q.rlike(r"\[소아\]|(?m)^소아\s*[:|]")
    return planted(spark, sf, _BRANCH).select("id", F.when(a & p, "common").when(a, "adult").when(p, "pediatric").when(q.rlike(r"\[[가-힣]+\]"), "explicit_other").otherwise("common").alias("branch"))


_ASKED = [(1, "성인과 소아의 용량"), (2, "성인에게 투여"), (3, "소아 주의사항"), (4, "성인병 예방"), (5, "용량은")]
_PERSON = r"(?:과|와|은|는|이|가|의|에게|[·‧/]|\s|[?!,.]|$)"


@query("n23_requested_branches", f"WITH b AS {sql_planted(_ASKED)} SELECT id::BIGINT AS id, concat_ws(',', CASE WHEN regexp_matches(q, '(^|[^가-힣])성인{_PERSON}') THEN 'adult' END, CASE WHEN regexp_matches(q, '(^|[^가-힣])소아{_PERSON}') THEN 'pediatric' END) AS branches FROM b")
def n23(spark, sf):
    q = F.col("q")
    return planted(spark, sf, _ASKED).select("id", F.array_join(F.array_compact(F.array(F.when(q.rlike(f"(?<![가-힣])성인{_PERSON}"), F.lit("adult")), F.when(q.rlike(f"(?<![가-힣])소아{_PERSON}"), F.lit("pediatric")))), ",").alias("branches"))


@query("n24_branch_stems", f"WITH b AS {values(_BRANCH, 'id, q')}, l AS (SELECT id, unnest(string_split(q, chr(10))) AS line FROM b) SELECT DISTINCT id::BIGINT AS id, trim(regexp_replace(line, '\\[[가-힣]+\\]', '', 'g')) AS stem FROM l WHERE regexp_matches(line, '\\[[가-힣]+\\]') AND length(trim(regexp_replace(line, '\\[[가-힣]+\\]', '', 'g'))) >= 4")
def n24(spark, sf):
    mark = r"\[[가-힣]+\]"
    lines = literal(spark, _BRANCH, SCHEMA).select("id", F.explode(F.split("q", "\n")).alias("line"))
    stem = F.trim(F.regexp_replace("line", mark, ""))
    return lines.filter(F.col("line").rlike(mark)).select("id", stem.alias("stem")).filter(F.length("stem") >= 4).distinct()


_MON = [(1, "성인 진정 중 산소포화도를 측정하나요"), (2, "소아 호흡수 확인"), (3, "맥박과 혈압을 관찰"), (4, "의식 상태를 평가해"), (5, "준비물")]
_ITEMS = {"respiratory_rate": "호흡\\s*수", "pulse": "맥박", "oxygen_saturation": "산소\\s*포화도|SpO2", "consciousness": "의식\\s*(?:상태|수준)"}
_ACTIONS = {"assess": "평가", "measure": "측정", "check": "확인|체크", "observe": "관찰"}


@query("n25_monitoring_qualifiers", f"WITH m AS {sql_planted(_MON)} SELECT id::BIGINT AS id, CASE {' '.join(f'WHEN regexp_matches(q, $${v}$$) THEN $${k}$$' for k, v in _ITEMS.items())} ELSE '' END AS item, CASE {' '.join(f'WHEN regexp_matches(q, $${v}$$) THEN $${k}$$' for k, v in _ACTIONS.items())} ELSE '' END AS action FROM m")
def n25(spark, sf):
    def first(rules):
        out = None
        for k, v in rules.items():
            out = F.when(F.col("q").rlike(v), k) if out is None else out.when(F.col("q").rlike(v), k)
        return out.otherwise("")

    return planted(spark, sf, _MON).select("id", first(_ITEMS).alias("item"), first(_ACTIONS).alias("action"))


@query("n26_procedure_action", f"WITH a AS {sql_planted(_ACTS)} SELECT id::BIGINT AS id, regexp_matches(q, '한다|하고|시행|실시|준비|기록') AS action FROM a")
def n26(spark, sf):
    return planted(spark, sf, _ACTS).select("id", F.col("q").rlike("한다|하고|시행|실시|준비|기록").alias("action"))


@query("n27_sentences", f"SELECT doc_id, i::BIGINT AS position, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {sql_sentences('text')} AS s FROM documents))")
def n27(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).cast("long").alias("position"), "sentence")


_WRAPPED = [
    (1, "1. 목적\n감염 예방을 위해\n손 위생을 시행하며\n기록한다. 0.5 mg을 준다.\n\n2) 준비"),
    (2, "- 장갑을 끼고\n가운을 입는다\n- 소독 방법\n별도 줄\n표 | 값\n이어지는 줄"),
    (3, "환자의\n상태를\n확인한다! 다음 문장。 끝"),
    (4, "문장이다.\n다음이다\n그리고 또는\n다른 것"),
    (5, "* 열린 항목\n계속\n: 끝\n또 계속"),
    (6, None),
]


def _units_sql(rows: str, key: str, text: str) -> str:
    last = "regexp_extract(acc, '[^\n]*$')"
    joins = f"x <> '' AND {last} <> '' AND NOT regexp_matches(x, '{D.UNIT_START}') AND NOT contains({last}, '|') AND NOT regexp_matches({last}, '{D.TERMINAL}') AND (regexp_matches({last}, '{D.GOES_ON}') OR (regexp_matches({last}, '{D.BULLET}') AND NOT regexp_matches({last}, '{D.TITLE_END}')))"
    lines = f"list_transform(string_split({text}, chr(10)), lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g')))"
    folded = f"CASE WHEN regexp_matches({text}, '[가-힣]|(?m)^\\s*[-•●▪Ÿ*※]') THEN list_reduce({lines}, lambda acc, x: CASE WHEN {joins} THEN acc || ' ' || x ELSE acc || chr(10) || x END, '') ELSE array_to_string({lines}, chr(10)) END"
    cut = f"regexp_replace({folded}, '((?:^|[^0-9])[.]|[!?。！？])[ ]+', '\\1' || chr(10), 'g')"
    return f"SELECT {key}, s[i] AS unit, i::BIGINT AS position FROM (SELECT {key}, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT {key}, list_filter(list_transform(string_split({cut}, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS s FROM {rows}))"


@query("n27_wrapped_lines", f"WITH w AS {values(_WRAPPED, 'id, q')} {_units_sql('w', 'id::BIGINT AS id', 'q').replace('SELECT id::BIGINT AS id, s[i]', 'SELECT id, s[i]').replace('SELECT id::BIGINT AS id, s, unnest', 'SELECT id, s, unnest')}")
def n27_wrapped(spark, sf):
    return literal(spark, _WRAPPED, SCHEMA).select("id", F.posexplode(X.source_units(F.col("q"))).alias("p", "unit")).select("id", "unit", (F.col("p") + 1).cast("long").alias("position"))


@query("n27_source_units", _units_sql("documents", "doc_id", "text"))
def n27_units(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.source_units(F.col("text"))).alias("p", "unit")).select("doc_id", "unit", (F.col("p") + 1).cast("long").alias("position"))


_MARKS = [(1, "1) 손을 씻는다"), (2, "- 장갑을 낀다"), (3, "• 확인한다"), (4, "확인한다"), (5, "가. 준비"), (6, "2. 10 mg 투여")]


@query("n28_leading_marker", f"WITH m AS {sql_planted(_MARKS)} SELECT id::BIGINT AS id, regexp_extract(q, '^\\s*([-•·]|[0-9]+[.)]|[가-하][.)])\\s+', 1) AS marker FROM m")
def n28(spark, sf):
    return planted(spark, sf, _MARKS).select("id", F.regexp_extract("q", r"^\s*([-•·]|[0-9]+[.)]|[가-하][.)])\s+", 1).alias("marker"))


@query("n29_step_projection", f"WITH m AS {sql_planted(_MARKS)} SELECT id::BIGINT AS id, nullif(regexp_extract(q, '^\\s*([0-9]+)[.)]\\s+', 1), '')::BIGINT AS step, regexp_replace(q, '^\\s*(?:[-•·]|[0-9]+[.)]|[가-하][.)])\\s+', '') AS statement FROM m")
def n29(spark, sf):
    return planted(spark, sf, _MARKS).select("id", F.nullif(F.regexp_extract("q", r"^\s*([0-9]+)[.)]\s+", 1), F.lit("")).cast("long").alias("step"), F.regexp_replace("q", r"^\s*(?:[-•·]|[0-9]+[.)]|[가-하][.)])\s+", "").alias("statement"))


_DOSE = [(1, "18 gauge 바늘로 1,000 ml/hour 주입"), (2, "5mg 을 10 분 간격, 5 mg"), (3, "없음"), (4, "20 ml/minute 이하")]
_NUM = "[0-9][0-9,]*(?:\\.[0-9]+)?\\s*(?:gauge|mg|ml|분|g)?(?:/hour|/minute|/hr|/min)?"


def _norm_sql(x):
    return f"replace(replace(replace(regexp_replace({x}, '[\\s,]', '', 'g'), 'gauge', 'g'), '/hour', '/hr'), '/minute', '/min')"


@query("n30_numeric_units", f"WITH d AS {sql_planted(_DOSE)} SELECT DISTINCT id::BIGINT AS id, {_norm_sql('t')} AS token FROM (SELECT id, unnest(regexp_extract_all(q, '{_NUM}')) AS t FROM d)")
def n30(spark, sf):
    norm = lambda x: F.replace(F.replace(F.replace(F.regexp_replace(x, r"[\s,]", ""), F.lit("gauge"), F.lit("g")), F.lit("/hour"), F.lit("/hr")), F.lit("/minute"), F.lit("/min"))
    return planted(spark, sf, _DOSE).select("id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("q", F.lit(_NUM), F.lit(0)), norm))).alias("token"))


_STATE = [(1, "투여하지 않는다"), (2, "단, 출혈 시 제외한다"), (3, "열이 있으면 보고한다"), (4, "확인한다"), (5, "소아의 경우 금지한다")]


@query("n31_markers", f"WITH s AS {sql_planted(_STATE)} SELECT id::BIGINT AS id, regexp_matches(q, '않|금지|안 된다') AS negation, regexp_matches(q, '이면|으면|경우|시 ') AS condition, regexp_matches(q, '단,|제외|예외') AS exception FROM s")
def n31(spark, sf):
    q = F.col("q")
    return planted(spark, sf, _STATE).select("id", q.rlike("않|금지|안 된다").alias("negation"), q.rlike("이면|으면|경우|시 ").alias("condition"), q.rlike("단,|제외|예외").alias("exception"))


@query("n32_embedding_question")
def n32(spark, sf):
    return planted(spark, sf, ASK).select("id", X.embedding_question(F.col("q")).alias("text"))


@query("n33_bounded_question", "WITH w AS (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark) SELECT item_id, least(len(w), 20)::BIGINT AS n, array_to_string(list_slice(w, 1, 20), ' ') AS bounded FROM w")
def n33(spark, sf):
    w = F.split(X.clean(F.col("text")), " ")
    return table(spark, sf, "benchmark").select("item_id", F.least(F.size(w), F.lit(20)).cast("long").alias("n"), F.array_join(F.slice(w, 1, 20), " ").alias("bounded"))


@query("n34_prefixes", "SELECT item_id, CASE WHEN starts_with(text, 'query: ') THEN text ELSE 'query: ' || text END AS query_text, CASE WHEN starts_with(text, 'passage: ') THEN text ELSE 'passage: ' || text END AS passage_text FROM benchmark")
def n34(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.prefixed(F.col("text"), "query: ").alias("query_text"), X.prefixed(F.col("text"), "passage: ").alias("passage_text"))


@query("n35_representation", "WITH c AS (SELECT doc_id, list_distinct([source, lang, source]) AS d, source, lang, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents) SELECT doc_id, source || ' ' || lang || ' ' || array_to_string(list_slice(w, 1, 30), ' ') AS representation FROM c")
def n35(spark, sf):
    parts = F.array_distinct(F.array(X.clean(F.col("source")), X.clean(F.col("lang")), X.clean(F.col("source")), F.array_join(F.slice(F.split(X.clean(F.col("text")), " "), 1, 30), " ")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(parts, " ").alias("representation"))


@query("n36_exact_signal", "SELECT doc_id, regexp_matches(text, '[0-9]|%|℃') AS exact FROM documents")
def n36(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike("[0-9]|%|℃").alias("exact"))


@query(
    "n37_directness",
    f"WITH {sql_bm25()}, p AS (SELECT t.query_id, t.chunk_id, len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct({sql_tokens('d.text')})))::DOUBLE / greatest(1, len(list_distinct({sql_tokens('b.text')}))) AS o, regexp_matches(d.text, '[0-9]') AS num FROM bm_top t JOIN benchmark b ON b.item_id = t.query_id JOIN documents d ON d.doc_id = t.chunk_id) SELECT query_id AS item_id, chunk_id AS doc_id, round(least(1.0, 0.8 * o + 0.2 * num::INT), 6)::DOUBLE AS directness FROM p",
)
def n37(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(X.lexical_tokens(F.col("text"))).alias("bt"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.array_distinct(X.lexical_tokens(F.col("text"))).alias("dt"), F.col("text").rlike("[0-9]").cast("int").alias("num"))
    pairs = bm25_top(spark, sf).select("query_id", "chunk_id").join(b, "query_id").join(d, "chunk_id")
    overlap = F.size(F.array_intersect("bt", "dt")) / F.greatest(F.lit(1), F.size("bt"))
    return pairs.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), F.round(F.least(F.lit(1.0), 0.8 * overlap + 0.2 * F.col("num")), 6).alias("directness"))


@query("n38_stable_ids", "SELECT doc_id, 'chunk-' || substring(sha256(doc_id::VARCHAR || '|' || source), 1, 20) AS stable_id FROM documents")
def n38(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.stable_id("chunk", F.col("doc_id"), F.col("source")).alias("stable_id"))


@query("n39_escapes", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped, replace(replace(html, '|', '\\|'), chr(10), '<br>') AS cell FROM pages")
def n39(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"), X.markdown_cell(F.col("html")).alias("cell"))


@query("n40_keyword_counts", "WITH k AS (SELECT unnest(['license', 'the', 'on an']) AS kw) SELECT doc_id, kw, ((length(text) - length(replace(text, kw, ''))) / length(kw))::BIGINT AS exact_n, ((length(regexp_replace(text, '\\s+', '', 'g')) - length(replace(regexp_replace(text, '\\s+', '', 'g'), replace(kw, ' ', ''), ''))) / length(replace(kw, ' ', '')))::BIGINT AS loose_n FROM documents, k")
def n40(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(k) for k in ("license", "the", "on an")])).alias("kw"))
    exact, loose = X.keyword_counts(F.col("text"), F.col("kw"))
    return rows.select("doc_id", "kw", exact.alias("exact_n"), loose.alias("loose_n"))


@query("n41_suggested_topics", "SELECT topic FROM (SELECT lower(source) AS topic, min(doc_id) AS first FROM documents GROUP BY 1 ORDER BY first LIMIT 4)")
def n41(spark, sf):
    return table(spark, sf, "documents").groupBy(F.lower("source").alias("topic")).agg(F.min("doc_id").alias("first")).orderBy("first").limit(4).select("topic")  # four suggestions


@query("n42_staleness", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') > 730 AS stale FROM orders")
def n42(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.datediff(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date")) > 730).alias("stale"))
