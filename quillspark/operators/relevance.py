"""Whether the body of a hit speaks of what a question asks: a title or a high score alone is not enough.

A row has, of the question, text (q), kind, entities and words (arrays: anchors and words of the topic) and what is watched, if
anything (item, phase, action); of the hit, text, section, name and title, and whether its body has substance and its heading is
that of the aspect asked for (substantive, headed). Null texts are empty, null arrays hold nothing, null flags are false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import anchors, compatible, let, temporal_phases, term_matches
from quillspark.plans.questions import current

# What a body has to hold for a question of a kind.
SUPPORT = {
    "materials": "준비|물품",
    "preparation": "준비|확인|평가|설명|동의|계획",
    "cautions": r"주의|금기|금지|않|말아|해서는\s*안|관찰|모니터링|감시|증상|징후|합병증|응급",
    "purpose": r"목적|정의|이란|란\s|예방|위해",
    "release": "해제|종료|중단|중지",
}
# What is watched, and how a body names it.
ITEMS = {
    "respiratory_rate": r"호흡\s*수|호흡수|(?<![a-z])RR(?![a-z])",
    "pulse": r"맥박|(?<![a-z])pulse(?![a-z])|(?<![a-z])HR(?![a-z])",
    "oxygen_saturation": r"산소\s*포화도|산소포화도|SpO2|Oxymetry",
    "consciousness": r"의식\s*(?:상태|수준)|의식상태|의식수준|MOAA/S",
}
# What a question asks for in particular, and what its answer then has to hold.
INTERVAL = (r"몇\s*분|얼마나\s*자주|간격", r"\d+(?:\.\d+)?\s*분\s*간격|간격")
CONSENT = ("동의서", "동의서")
SATURATION = r"산소\s*포화도|산소포화도|spo2"
VITAL = (r"활력\s*징후|활력징후|v/s", r"활력\s*징후|활력징후|V/S|혈압|맥박|호흡수")
WATCH, WATCHED = "모니터링|관찰|확인|측정|평가", "모니터링|관찰|감시|확인|측정|평가"
DRUG = ("투약|투여|약물", "투약|투여|약물|약품명|용량|용법")
RECOVERY = ("회복", "회복")
WARD = ("입원실|병실|이동", ("입원실|병실", "이동|모니터링|관찰"))


def qualifiers(question: Column, item: Column, action: Column, text: Column) -> tuple[Column, Column]:
    """Whether a question asks for anything in particular, and whether a text holds all of that."""
    now = current(question)
    asks = lambda p: now.rlike(f"(?i){p}")
    holds = lambda p: text.rlike(f"(?i){p}")
    watched = action.isNotNull()
    rules = [
        (asks(INTERVAL[0]), holds(INTERVAL[1])),
        (asks(CONSENT[0]), holds(CONSENT[1])),
        *[(item.eqNullSafe(k), holds(p)) for k, p in ITEMS.items()],
        (item.isNull() & asks(SATURATION), holds(ITEMS["oxygen_saturation"])),
        (asks(VITAL[0]), holds(VITAL[1])),
        (watched, holds(WATCHED)),
        (~watched & asks(WATCH), holds(WATCH)),
        (asks(DRUG[0]), holds(DRUG[1])),
        (asks(RECOVERY[0]), holds(RECOVERY[1])),
        (asks(WARD[0]), holds(WARD[1][0]) & holds(WARD[1][1])),
    ]
    any_asked, all_held = F.lit(False), F.lit(True)
    for asked, held in rules:
        any_asked, all_held = any_asked | asked, all_held & (~asked | held)
    return any_asked, all_held


def relevant() -> Column:
    """The verdict on a row. Entities of the question decide, where it names any; else its topic, aspect and particulars do."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    text, context = some("text"), F.concat_ws(" ", some("text"), some("section"))
    phased = F.col("item").isNotNull() & F.col("phase").isNotNull()
    timely = ~phased | F.array_contains(temporal_phases(context), F.col("phase"))
    about = lambda where: F.exists(listed("words"), lambda w: term_matches(w, where))
    in_body, headed = about(text), flag("headed")
    on_topic = in_body | about(F.concat_ws(" ", some("name"), some("title"), some("section"))) | headed
    asked, held = qualifiers(some("q"), F.col("item"), F.col("action"), text)
    aspect = F.lit(None).cast("boolean")
    for kind, pattern in SUPPORT.items():
        aspect = F.when(F.col("kind") == kind, text.rlike(f"(?i){pattern}")).otherwise(aspect)
    by_topic = (
        F.when(aspect.isNotNull(), headed | (on_topic & aspect & held))
        .when(F.col("kind") == "summary", on_topic)
        .when((F.col("kind") == "comparison") | ((F.col("kind") == "fact") & asked), on_topic & held)
        .otherwise(in_body | headed)
    )
    by_entity = let(listed("entities"), lambda e: F.arrays_overlap(e, anchors(context)))
    verdict = F.when(F.size(listed("entities")) > 0, by_entity).otherwise((F.size(listed("words")) > 0) & by_topic)
    return F.coalesce(compatible(some("q"), context) & flag("substantive") & timely & verdict, F.lit(False))
