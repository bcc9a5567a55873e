"""Question planning: kind, domain, topics, scope, route, expansion; a row of the plan for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import terms as D
from quillspark.functions import text as X

MORE = " / 추가 질문: "

# Kinds of question in the order in which they are tried.
_PREPARE = r"준비사항|체크\s*사항|확인\s*사항|뭘\s*준비|준비할\s*(?:것|항목)|(?:^|\s)(?:준비|확인)(?:\s|[?!,.]|$)"
_PHASE = r"사전|이전|전(?:에|에는|의|\s|$)"
_DO = r"준비(?:할|해야|해)|확인(?:할|해야|해)|체크(?:할|해야|해)"
_STEPS = r"방법|절차|순서|(?:^|\s)(?:시행|진행)(?:\s|[?!,.]|$)"
KINDS: tuple[tuple[str, str], ...] = (
    ("comparison", r"비교|차이|다른 점|다른점|어떻게\s*달라|뭐가\s*달라"),
    ("synthesis", r"종합|여러 문서|여러 지침|함께 정리|문서 간|문서간"),
    ("materials", r"준비물|물품"),
    ("preparation", ""),
    ("purpose", r"목적|정의|이유|왜\s*(?:시행|수행|하|해|하는|필요)"),
    ("release", r"해제|종료 기준|중단 기준"),
    ("procedure", _STEPS),
    ("cautions", r"주의|금기|관찰|모니터링|보고|조심|이상\s*증상|문제가\s*생기면|(?:^|\s)안전(?:\s|[?!,.]|$)|안전하게.{0,12}(?:봐야|확인|관찰)"),
    ("summary", r"요약|정리|쉽게|신규간호사|전체적|전반적|간단히|(?:에\s*대해|에\s*관해).{0,20}(?:알려|설명)|(?:^|\s)[가-힣a-zA-Z0-9-]{2,}(?:은|는|이|가)?\s+(?:알려줘|알려주세요)$"),
    ("procedure", r"어떻게|" + _STEPS),
)

# What is outside, and what belongs to a hospital.
OUTSIDE = r"(?i)날씨|주식|코인|비트코인|로또|운세|연애|맛집|여행\s*(?:추천|일정)|우주선|축구\s*(?:경기\s*)?결과|파이썬\s*코드|영화\s*추천"
HOSPITAL = "간호|병원|환자|진료|투약|투여|수혈|수술|검사|감염|격리|소독|세척|도뇨|카테터|배액|활력|혈압|혈당|산소|심폐|응급|낙상|욕창|처방|병동|직원|교육실|인계|병실"
EDUCATION = r"(?i)(?<![가-힣a-zA-Z0-9-])[가-힣a-zA-Z0-9-]{2,}교육\s*(?:목적|준비|주의|방법|절차)"
SEDATION = r"진정.{0,20}(?:치료|시행|수행|전|중|후|목적|준비|확인|체크|주의|조심|안전|평가|동의|투약|모니터링)"

# What asks for a picture or a table, and how a follow-up begins.
IMAGE = r"(?i)이미지|그림|도식|도표\s*화면|화면|스크린샷|캡처|workflow|flowchart"
TABLE = r"(?i)표(?:로|에서|의|를|는|$)|비교|차이|제품별|제제별|항목별|보관|온도|속도|용량|투여량|간격|몇\s*(?:분|시간|일|회|번)|유효\s*기간|수치|기준값|단위"
FOLLOWS = r"^(?:그럼|그때|그것|이어서|추가로|아까|주의사항은|준비물은|해제 기준)|이 두 (?:지침|문서)|이 문서|이 지침|쉽게 정리|보기 쉽게"


def current(question: Column) -> Column:
    return F.element_at(F.split(question, MORE), -1)


def classify(question: Column) -> Column:
    q = current(question)
    out = None
    for kind, pattern in KINDS:
        rule = q.rlike(pattern) if pattern else q.rlike(_PREPARE) | (q.rlike(_PHASE) & q.rlike(_DO))
        out = F.when(rule, kind) if out is None else out.when(rule, kind)
    return out.otherwise("fact")


def domain(question: Column, named: Column | None = None) -> Column:
    """named: whether the question names an anchor; without it those count that stand as words of their own."""
    inside = (F.size(X.anchors(question)) > 0 if named is None else named) | question.rlike(HOSPITAL) | current(question).rlike(SEDATION) | current(question).rlike(EDUCATION)
    return F.when(current(question).rlike(OUTSIDE), "out_of_scope").when(inside, "hospital").otherwise("unknown")


def evidence_route(question: Column, kind: Column) -> Column:
    image, tab = question.rlike(IMAGE), (kind == "comparison") | question.rlike(TABLE)
    return F.when(image & tab, "mixed").when(image, "image").when(tab, "table").otherwise("text")


def follow_up(question: Column) -> Column:
    return question.rlike(FOLLOWS)


def merged_question(question: Column, previous: Column, follows: Column) -> Column:
    """The first 140 characters of the first question, the last 160 of the latest, and the question; a new topic drops them."""
    parts = F.split(previous, MORE)
    head = F.substring(parts[0], 1, 140)
    last = F.element_at(parts, -1)
    tail = F.when(F.size(parts) > 1, F.concat(F.lit(MORE), F.substring(last, F.greatest(F.length(last) - 159, F.lit(1)), F.lit(160)))).otherwise("")
    old, new = X.anchors(previous), X.anchors(question)
    changed = (F.size(old) > 0) & (F.size(new) > 0) & ~F.arrays_overlap(old, new)
    return F.when(follows & (F.coalesce(previous, F.lit("")) != "") & ~changed, F.concat(head, tail, F.lit(MORE), question)).otherwise(question)


def document_topics(docs: DataFrame, name: str, key: str) -> DataFrame:
    """key, topic: parts of a document's name without extension and label, of two letters or more."""
    stem = F.regexp_replace(X.clean(F.col(name)), r"(?i)\.[a-z0-9]{1,8}$", "")
    part = F.regexp_replace(F.lower("part"), "[^가-힣a-z0-9-]", "")
    labels = "|".join(sorted(D.DOCUMENT_LABELS, key=len, reverse=True))
    bare = F.regexp_replace("c", f"^(?:{labels})(?=..)", "")
    rows = docs.select(key, F.explode(F.split(stem, r"[_/\\>|·]+")).alias("part")).select(key, part.alias("c")).select(key, bare.alias("topic"))
    return rows.filter((F.length("topic") >= 2) & ~F.col("topic").isin(*D.DOCUMENT_LABELS)).distinct()


def canonical_topics(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """id, topic: for questions whose terms, each meeting one topic, meet one topic in all. topics: topic.

    Equal keys meet: a topic stands under its own name and under that without a role at its end.
    """
    roles = "|".join(D.TOPIC_ROLES)
    names = topics.select("topic").distinct().select("topic", F.explode(F.array_distinct(F.array("topic", F.regexp_replace("topic", f"(?<=..)(?:{roles})$", "")))).alias("key"))
    asked = questions.select("id", F.explode(X.query_terms(current(F.col("q")))).alias("key")).filter(~F.col("key").isin(*D.INTENT_TERMS, *D.QUERY_NOISE))
    single = asked.join(names, "key").groupBy("id", "key").agg(F.count_distinct("topic").alias("n"), F.min("topic").alias("topic")).filter("n = 1")
    return single.groupBy("id").agg(F.count_distinct("topic").alias("n"), F.min("topic").alias("topic")).filter("n = 1").select("id", "topic")


def expansions(question: Column) -> Column:
    low = F.lower(question)
    own = [F.when(F.contains(low, F.lit(k)), F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>")) for k, words in D.EXPANSIONS.items()]
    table = F.create_map(*[x for k, words in D.ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in words]))])
    return F.concat(*own, F.flatten(F.transform(X.anchors(question), lambda a: table[a])))


def expanded(question: Column) -> Column:
    return X.clean(F.array_join(F.array_distinct(F.concat(F.array(question), expansions(question))), " "))


def plan(questions: DataFrame) -> DataFrame:
    """One plan for each question (id, q)."""
    q = X.split_attached_aspects(X.clean(F.col("q")))
    base = questions.select("id", q.alias("query")).withColumn("kind", classify(F.col("query")))
    style = F.create_map(*[x for k, v in D.STYLE.items() for x in (F.lit(k), F.lit(v))])
    broad = F.col("kind").isin("comparison", "synthesis", "summary")
    return base.select(
        "id",
        "query",
        "kind",
        style[F.col("kind")].alias("format"),
        domain(F.col("query")).alias("domain"),
        evidence_route(F.col("query"), F.col("kind")).alias("route"),
        F.array_join(X.anchors(F.col("query")), ",").alias("entities"),
        expanded(F.col("query")).alias("expanded"),
        F.when(broad, 8).otherwise(6).alias("max_seeds"),
        F.when(broad, 14).otherwise(12).alias("max_hits"),
    )
