"""Relevant bodies and styles of answers over all turns of the conversations, with questions and phrases planted."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import terms as D
from quillspark.operators import relevance
from quillspark.plans import questions as P
from quillspark.queries import plan
from quillspark.queries.common import literal, planted, table, values

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


# A question, its kind, and what it watches; one names an entity.
_ASKS = [
    (0, "욕창 주의사항", "cautions", None, None, None, None), (1, "욕창 준비물", "materials", None, None, None, None), (2, "욕창 전 확인과 동의서", "preparation", None, None, None, None), (3, "욕창 치료 중단 기준", "release", None, None, None, None),
    (4, "욕창 요약", "summary", None, None, None, None), (5, "욕창 혈압은 몇 분마다", "fact", None, None, None, None), (6, "욕창", "fact", None, None, None, None), (7, "욕창과 활력징후 비교", "comparison", None, None, None, None),
    (8, "시술 중 산소포화도 감시", "cautions", None, "oxygen_saturation", "during", "watch"), (9, "욕창 맥박 주의", "cautions", None, "pulse", None, "check"), (10, "VRE 욕창 주의", "cautions", "vre", None, None, None), (11, "욕창 병실 이동 주의 / 추가 질문: 회복", "cautions", None, None, None, None),
    (12, "욕창 투약 절차", "procedure", None, None, None, None), (13, "욕창 산소 포화도 주의", "cautions", None, None, None, None),
]
_BODIES = [(i, b) for i, b in enumerate(("부위를 관찰한다", "10분 간격으로 혈압과 맥박을 측정한다", "동의서를 확인하고 설명한다", "시술 중 SpO2를 감시한다", "물품을 준비한다", "병실로 이동하면 회복을 평가한다", "투여를 중단한다", "씻는다", "hr 80, 주의"))]
_NAMES = "k, q, kind, entity, item, phase, action"
_N, _M = len(_ASKS), len(_BODIES)
_HIT = {
    "text": "concat(turn_text, CASE WHEN id % 3 = 0 THEN ' 욕 창 ' ELSE ' ' END, body)",
    "section": "CASE WHEN id % 5 = 0 THEN 'VRE' WHEN id % 5 = 1 THEN '' END",
    "name": "CASE WHEN id % 9 = 1 THEN '욕창.pdf' ELSE '' END",
    "title": "CASE WHEN id % 6 = 1 THEN '욕창 지침' END",
    "substantive": "id % 13 <> 0",
    "headed": "CASE WHEN id % 11 = 0 THEN true END",
}


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace("(?<![a-z])", "(?:^|[^a-z])").replace("(?![a-z])", "(?:$|[^a-z])")


_HOLDS = lambda p: f"regexp_matches(text, '{_re2(p)}')"
_NEEDS = lambda p: f"regexp_matches(now, '(?i){p}')"
_RULES = [
    *[(_NEEDS(a), _HOLDS(h)) for a, h in (relevance.INTERVAL, relevance.CONSENT, relevance.VITAL, relevance.DRUG, relevance.RECOVERY)],
    *[(f"coalesce(item = '{k}', false)", _HOLDS(p)) for k, p in relevance.ITEMS.items()],
    (f"(item IS NULL AND {_NEEDS(relevance.SATURATION)})", _HOLDS(relevance.ITEMS["oxygen_saturation"])),
    ("action IS NOT NULL", _HOLDS(relevance.WATCHED)),
    (f"(action IS NULL AND {_NEEDS(relevance.WATCH)})", _HOLDS(relevance.WATCH)),
    (_NEEDS(relevance.WARD[0]), f"({_HOLDS(relevance.WARD[1][0])} AND {_HOLDS(relevance.WARD[1][1])})"),
]
_ABOUT = lambda c: f"contains(replace({c}, ' ', ''), '욕창')"


@query(
    "e02_topic_relevance",
    f"""WITH t AS (SELECT 1000 * conv_id + turn AS id, text AS turn_text FROM conversations), j AS (SELECT t.*, a.*, b.body FROM t JOIN {values(_ASKS, _NAMES)} a ON a.k = id % {_N} JOIN {values(_BODIES, 'b, body')} b ON b.b = id // {_N} % {_M}),
h AS (SELECT id, q, kind, entity, item, phase, action, body, {', '.join(f'{v} AS {k}' for k, v in _HIT.items())}, string_split(q, ' / 추가 질문: ')[-1] AS now FROM j),
f AS (SELECT *, {' OR '.join(a for a, _ in _RULES)} AS asked, {' AND '.join(f'(NOT {a} OR {h})' for a, h in _RULES)} AS held, coalesce(section, '') = 'VRE' AS vre, coalesce(headed, false) AS head, {_ABOUT('text')} AS in_body,
 {_ABOUT('text')} OR {_ABOUT("concat_ws(' ', name, coalesce(title, ''), coalesce(section, ''))")} OR coalesce(headed, false) AS topic FROM h)
SELECT id, substantive AND (entity IS NULL OR vre) AND (phase IS NULL OR body LIKE '시술 중%') AND CASE WHEN entity IS NOT NULL THEN vre {' '.join(f"WHEN kind = '{k}' THEN head OR (topic AND {_HOLDS(p)} AND held)" for k, p in relevance.SUPPORT.items())}
 WHEN kind = 'summary' THEN topic WHEN kind = 'comparison' OR (kind = 'fact' AND asked) THEN topic AND held ELSE in_body OR head END AS relevant FROM f""",
)
def e02_topic(spark, sf):
    asks = F.broadcast(literal(spark, _ASKS, "k long, q string, kind string, entity string, item string, phase string, action string"))  # as many rows as are written here
    bodies = F.broadcast(literal(spark, _BODIES, "b long, body string"))
    turns = table(spark, sf, "conversations").select((1000 * F.col("conv_id") + F.col("turn")).alias("id"), F.col("text").alias("turn_text"))
    rows = turns.join(asks, F.col("id") % _N == F.col("k")).join(bodies, F.floor(F.col("id") / _N) % _M == F.col("b"))
    entities = F.when(F.col("entity").isNotNull(), F.array("entity"))
    hits = rows.select("id", "q", "kind", entities.alias("entities"), F.array(F.lit("욕창")).alias("words"), "item", "phase", "action", *[F.expr(v).alias(k) for k, v in _HIT.items()])
    return hits.select("id", relevance.relevant().alias("relevant"))


_STYLES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.STYLE.items())
_FOCUS = " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in D.FOCUSES.items())


@query("p14_turn_styles", f"WITH k AS ({plan.ORACLES['p02_intent']}) SELECT id, kind, CASE kind {_STYLES} ELSE '' END AS style, CASE kind {_FOCUS} ELSE '' END AS focus FROM k")
def p14_turns(spark, sf):
    of = lambda known: F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("kind")], F.lit(""))
    rows = planted(spark, sf, plan.ASK).select("id", P.classify(F.col("q")).alias("kind"))
    return rows.select("id", "kind", of(D.STYLE).alias("style"), of({k: ",".join(v) for k, v in D.FOCUSES.items()}).alias("focus"))
