"""What a unit of a source asks to be done: phases, families of actions, and actions with their strength.

All are column functions. A clause ends at a mark of a sentence, a semicolon or a line's end. Within a clause a phrase ends at
a comma or after a word that joins two actions; an action in such a word belongs to the phrases on both sides of it. Null
text gives null, text without an action none. Compatibility forms are not resolved here: see unicode.normal_form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import lower_clean
from quillspark.plans.questions import classify, current

# Kinds of actions.
KINDS = {
    "prohibit": r"금지|해서는\s*안|하면\s*안|하지\s*말",
    "caution": "주의|유의",
    "stop": "중단|중지",
    "measure": "측정|계측",
    "verify": "확인|점검",
    "execute": "시행|수행|실시",
    "administer": "투여|투약|주입",
    "prepare": "준비|구비",
    "record": "기록|기재|작성",
    "collect": "채혈|채취",
    "connect": "연결|장착",
    "remove": "제거|발관",
}
# How strongly a phrase asks, in the order in which they are tried.
NEGATED = r"하지\s*(?:않|말)|해서는\s*안|하면\s*안|금지"
CONSIDER = r"고려|여부\s*(?:를\s*)?검토|검토\s*(?:한다|함)"
RECOMMENDED = "권고|권장|바람직"
OPTIONAL = r"할\s*수\s*있|가능|선택"
IMMEDIATE = r"즉시|지체\s*없이|바로"
MANDATORY = r"반드시|필수|해야\s*(?:한다|함)|하여야\s*(?:한다|함)"
# Where clauses and phrases end, and what makes an action a time.
CLAUSE_END = r"[.!?。！？;\n]+"
PHRASE_END = r"\S+(?:하며|하고|하여|해서)\s+|[,]\s*"
TIME_SUFFIX = r"\s*(?:을|를)?\s*(?:전|후|중|시)"
TIME_END = r"\s|$|[,.)]"
# Words of a phase, and how it stands after an event.
PHASE_WORDS = {"before": ("사전", "이전"), "during": ("동안",), "after": ("이후",)}
SHORT_PHASES = {"전": "before", "중": "during", "후": "after"}
PHASE_END = r"$|[\s·‧/(),.\[\]]|으로|인|의"
EVENT = r"[가-힣a-zA-Z0-9()/-]{2,}(?:\s+[가-힣a-zA-Z0-9()/-]{2,}){0,3}\s+(전|중|후)"
CONTINUED = r"[·‧/,]\s*(전|중|후)"
# Families of actions by the roots of their words.
FAMILIES = {
    "assessment": ("확인", "평가", "측정"),
    "execution": ("시행", "수행", "세척", "교체", "준비", "연결", "제거", "소독", "주입", "투여", "투약", "사용", "중단"),
    "documentation": ("작성", "기록", "표시", "서명"),
    "communication": ("보고", "설명", "동의"),
    "monitoring": ("관찰", "모니터링"),
    "transfer": ("이동",),
}
# What asks for a whole procedure, and what for a part of it.
BROAD = r"(?i)절차|순서|방법|어떻게|과정|단계"
NARROW = r"(?i)용량|투여량|세척량|속도|주기|간격|몇\s*(?:회|번|mg|ml)|해제|종료\s*기준|중단\s*기준|준비물|주의사항|금기|목적|정의"

_CUT = "\u0001"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def families(text: Column) -> Column:
    """Families of actions that a text names."""
    return F.array_compact(F.array(*[F.when(text.rlike("|".join(roots)), F.lit(k)) for k, roots in FAMILIES.items()]))


def unit_phases(text: Column) -> Column:
    """Which of before, during and after a unit names."""
    low = lower_clean(text)
    marks = F.concat(*[F.regexp_extract_all(low, F.lit(f"{p}(?={PHASE_END})"), F.lit(1)) for p in (EVENT, CONTINUED)])
    return F.array_compact(
        F.array(
            *[
                F.when(low.rlike(f"(?<![가-힣a-z0-9])(?:{'|'.join(PHASE_WORDS[p])})(?![가-힣a-z0-9])") | F.array_contains(marks, short), F.lit(p))
                for short, p in SHORT_PHASES.items()
            ]
        )
    )


def broad_procedure(question: Column) -> Column:
    """Whether a question asks for a procedure as a whole: by kind and words, not for a part, and not for exactly one phase."""
    q = current(question)
    return (classify(question) == "procedure") & q.rlike(BROAD) & ~q.rlike(NARROW) & (F.size(unit_phases(q)) != 1)


def strength(phrase: Column, kind: str) -> Column:
    """How strongly a phrase asks for an action. What has no mark is required, but for a caution."""
    if kind == "prohibit":
        return F.lit("prohibited")
    rules = ((NEGATED, "prohibited"), (CONSIDER, "consider"), (RECOMMENDED, "recommended"), (OPTIONAL, "optional"), (IMMEDIATE, "immediate_required"), (MANDATORY, "required"))
    return F.coalesce(*[F.when(phrase.rlike(p), name) for p, name in rules], F.lit("caution" if kind == "caution" else "required"))


def _clause_signatures(clause: Column) -> Column:
    """kind and strength of the actions of a clause, by kind, then place. Kinds that the clause doesn't name are not looked for in its phrases."""
    plain = F.translate(clause, _CUT, " ")

    def at(pieces: Column, phrases: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(pieces) - 1)

        def count(piece: Column, kind: str) -> Column:
            return F.regexp_count(piece, F.lit(f"(?:{KINDS[kind]})(?!{TIME_SUFFIX}(?:{TIME_END}))"))

        def has(i: Column, kind: str) -> Column:
            beside = F.when(i % 2 == 1, count(F.get(pieces, i - 1), kind) + count(F.get(pieces, i + 1), kind)).otherwise(0)
            return count(F.get(phrases, i), kind) > beside

        def of(kind: str) -> Column:
            found = F.transform(F.filter(places, lambda i: has(i, kind)), lambda i: F.get(phrases, i))
            return F.when(plain.rlike(KINDS[kind]), found).otherwise(F.array().cast("array<string>"))

        def signed(kind: str, own: Column) -> Column:
            return F.transform(own, lambda p: F.struct(F.lit(kind).alias("kind"), strength(p, kind).alias("strength")))

        stopped = of("stop")
        return F.concat(*[signed(k, F.filter(of(k), lambda p: ~F.array_contains(stopped, p)) if k == "administer" else of(k)) for k in KINDS])

    def phrases(pieces: Column) -> Column:
        return F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.concat(F.get(pieces, i - 1), p, F.get(pieces, i + 1))))

    marked = F.regexp_replace(plain, f"({PHRASE_END})", f"{_CUT}$1{_CUT}")
    found = _let(F.split(marked, _CUT), lambda pieces: _let(phrases(pieces), lambda own: at(pieces, own)))
    return F.when(plain.rlike("|".join(KINDS.values())), found).otherwise(F.array().cast("array<struct<kind:string,strength:string>>"))


def signatures(text: Column) -> Column:
    """kind and strength of the actions of a text, each pair once, in order."""
    return of_clauses(clauses(text))


def clauses(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, CLAUSE_END), lambda c: F.trim(c)), lambda c: c != "")


def of_clauses(found: Column) -> Column:
    """signatures() of a text with these clauses."""
    return F.array_distinct(F.flatten(F.transform(found, _clause_signatures)))


def strength_check(statement: Column, source: Column) -> Column:
    """passed, error_code, and the kinds and strengths of both: what a statement asks must be asked, as strongly, by its source.

    statement, source: signatures. A statement without an action passes.
    """

    def kinds(own: Column) -> Column:
        return F.array_distinct(F.transform(own, lambda s: s["kind"]))

    changed = F.size(F.array_except(kinds(statement), kinds(source))) > 0
    weaker = F.size(F.array_except(statement, source)) > 0
    code = F.when(changed, "evaluation_action_kind_changed").when(weaker, "evaluation_action_strength_changed")
    strengths = [F.array_distinct(F.transform(x, lambda s: s["strength"])) for x in (source, statement)]
    return F.struct((~weaker).alias("passed"), code.alias("error_code"), kinds(source).alias("source_kinds"), kinds(statement).alias("statement_kinds"), strengths[0].alias("source_strengths"), strengths[1].alias("statement_strengths"))
