"""Validation of selected source units against the contract they were asked by: the first reason against a selection, or ''.

Everything is grouped by query_id, whose catalogue is bounded by a prompt. Columns of the tables:

plans     query_id, procedure, broad (booleans), actions (array: what the question asks to be done), covered (boolean: there is
          a coverage), covered_groups, covered_branches (arrays, in order), most (units that may be selected at most)
slots     query_id, slot, slot_no, group_key, branch, required, allowed (array of units)
units     query_id, unit, ord, group_key, branch, required, selectable, phase, families (array), text
answers   query_id, raw: {"group_selections": {slot: [unit, ...]}}, or for slots of facets {"facet_selections": {slot: unit}}

Null or broken JSON, a null among the units, missing or further keys are a fault of the schema. A plan without an answer is
one of an empty text; answers without a plan are left out. Empty tables give an empty result. Columns of other names are left
out; rows of one query_id and slot, or unit, are expected once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The branch of what holds for all.
COMMON = "common"
# Phases that an answer has to cover.
PHASES = ["before", "during", "after"]

_SLOT_TYPE = r"(?:`[^`]*`|\w+): ARRAY<(?:STRING|VOID)>"
_SHAPE = rf"^OBJECT<group_selections: OBJECT<(?:{_SLOT_TYPE}(?:, {_SLOT_TYPE})*)?>>$"


def _set(of: Column, where: Column) -> Column:
    return F.collect_set(F.when(where, of))


def _lost(needed: str, held: str) -> Column:
    return F.size(F.array_except(needed, held)) > 0


def requirements(plans: DataFrame, units: DataFrame) -> DataFrame:
    """query_id, phase_slots, action_slots, all_families, capacity: what an answer to a broad procedure has to cover.

    Of required and selectable units of the covered groups: each phase of a branch, the families of actions of the first unit
    of each such phase, all families, and whether one unit for each of these, the first, fits into what may be selected.
    """
    broad = plans.filter("procedure AND broad AND covered").select("query_id", "covered_groups", "most")
    able = units.join(broad, "query_id").filter(F.col("required") & F.col("selectable") & F.array_contains("covered_groups", F.col("group_key")))
    able = able.select("query_id", "unit", "ord", "group_key", "branch", "phase", "families")
    slot = F.concat_ws("/", "branch", "phase")
    by_group = able.groupBy("query_id", "group_key").agg(F.min_by("unit", "ord").alias("unit"))
    by_phase = able.filter(F.col("phase").isin(PHASES)).groupBy("query_id", slot.alias("slot")).agg(F.min_by(F.struct("unit", "families"), "ord").alias("f")).select("query_id", "slot", "f.unit", "f.families")
    by_family = able.select("query_id", "unit", "ord", F.explode("families").alias("family")).groupBy("query_id", "family").agg(F.min_by("unit", "ord").alias("unit"))
    none = F.lit(None).cast("string")
    parts = (
        by_group.select("query_id", "unit", F.col("group_key").alias("g"), none.alias("s"), F.array().cast("array<string>").alias("a"), none.alias("f"))
        .unionByName(by_phase.select("query_id", "unit", none.alias("g"), F.col("slot").alias("s"), F.transform("families", lambda x: F.concat_ws("/", "slot", x)).alias("a"), none.alias("f")))
        .unionByName(by_family.select("query_id", "unit", none.alias("g"), none.alias("s"), F.array().cast("array<string>").alias("a"), F.col("family").alias("f")))
    )
    told = parts.groupBy("query_id").agg(F.count_distinct("unit").alias("witness"), F.collect_set("g").alias("found"), F.collect_set("s").alias("phase_slots"), F.flatten(F.collect_list("a")).alias("action_slots"), F.collect_set("f").alias("all_families"))
    empty = F.array().cast("array<string>")
    rows = broad.join(told, "query_id", "left").withColumns({c: F.coalesce(c, empty) for c in ("found", "phase_slots", "action_slots", "all_families")})
    fits = ~_lost("covered_groups", "found") & (F.coalesce("witness", F.lit(0)) <= F.col("most"))
    return rows.select("query_id", "phase_slots", "action_slots", "all_families", fits.alias("capacity"))


def _known(units: DataFrame) -> DataFrame:
    return units.select("query_id", "unit", "ord", F.col("group_key").alias("g"), F.col("branch").alias("b"), "selectable", "phase", "families", "text", F.lit(True).alias("known"))


def _seen(picked: DataFrame) -> DataFrame:
    """What the selected units of each answer are and cover."""
    has = F.col("unit").isNotNull()
    place = F.concat_ws("/", "b", "phase")
    named = has & (F.col("phase") != "unspecified")
    return picked.groupBy("query_id").agg(
        F.count("unit").alias("n"),
        F.count_distinct("unit").alias("n_distinct"),
        F.count_if(has & F.col("known").isNull()).alias("n_unknown"),
        F.count_if(~F.coalesce("selectable", F.lit(True))).alias("n_closed"),
        F.bool_or("back").alias("back"),
        F.collect_set("g").alias("got_groups"),
        _set(F.col("b"), F.col("b") != COMMON).alias("got_branches"),
        _set(place, named).alias("got_phases"),
        F.array_distinct(F.flatten(F.collect_list(F.when(named, F.transform("families", lambda x: F.concat_ws("/", place, x)))))).alias("got_actions"),
        F.array_distinct(F.flatten(F.collect_list("families"))).alias("got_families"),
        F.concat_ws("\n", F.collect_list("text")).alias("got_text"),
    )


def _covering() -> Column:
    """The first of what the selected units leave uncovered, or ''."""
    why = (
        F.when(_lost("covered_branches", "got_branches"), "selection_branch")
        .when(_lost("covered_groups", "got_groups"), "selection_missing_group")
        .when(~F.coalesce("capacity", F.lit(True)), "selection_requirement_capacity")
        .when(F.coalesce(_lost("phase_slots", "got_phases"), F.lit(False)), "selection_missing_phase")
        .when(F.coalesce(_lost("action_slots", "got_actions"), F.lit(False)), "selection_missing_phase_action")
        .when(F.size("got_families") < F.coalesce(F.size("all_families"), F.lit(0)), "selection_insufficient_action_diversity")
        .when(F.exists("actions", lambda a: ~F.contains(F.col("got_text"), a)), "selection_missing_action")
    )
    return F.coalesce(why, F.lit(""))


def validate(plans: DataFrame, slots: DataFrame, units: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, n_selected, reason. The checks come in this order, of which the first that fails is told:

    the shape of the answer; none, too many, repeated, unknown and unselectable units; slot by slot units of another group,
    units out of order, a required slot without one; a contract that isn't that of the plan and the units; units out of order
    from slot to slot; then, for procedures, branches, groups, capacity, phases, actions of phases, families and actions of
    the question that no selected unit covers.
    """
    p = plans.join(answers.select("query_id", "raw"), "query_id", "left")
    p = p.withColumn("v", F.try_parse_json("raw"))
    shaped = F.coalesce(F.schema_of_variant("v").rlike(_SHAPE), F.lit(False))
    given = F.when(shaped, F.try_variant_get("v", "$.group_selections", "map<string,array<string>>"))
    p = p.withColumn("given", given).drop("v", "raw")
    asked = slots.groupBy("query_id").agg(
        F.array_sort(F.collect_list("slot")).alias("names"),
        F.array_sort(F.collect_list(F.struct("slot_no", "slot", "group_key", "branch", "required", "allowed"))).alias("slots"),
    )
    p = p.join(asked, "query_id", "left")
    whole = F.coalesce((F.array_sort(F.map_keys("given")) == F.col("names")) & ~F.exists(F.map_values("given"), lambda x: F.coalesce(F.exists(x, lambda u: u.isNull()), F.lit(True))), F.lit(False))
    p = p.withColumn("schema", whole)

    picked = p.filter("schema").select("query_id", F.explode("slots").alias("s"), "given").select("query_id", "s.*", F.posexplode_outer(F.element_at("given", F.col("s.slot"))).alias("at", "unit"))
    picked = picked.join(_known(units), ["query_id", "unit"], "left")
    in_slot = Window.partitionBy("query_id", "slot_no").orderBy("at")
    in_all = Window.partitionBy("query_id").orderBy("slot_no", "at")
    has = F.col("unit").isNotNull()
    # The unit before in the whole answer: empty slots hold none, and are passed over.
    picked = picked.withColumn("slot_back", F.coalesce(F.lag("ord").over(in_slot) > F.col("ord"), F.lit(False)))
    before = F.last("ord", ignorenulls=True).over(in_all.rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("back", F.coalesce(before > F.col("ord"), F.lit(False)))
    per_slot = picked.groupBy("query_id", "slot_no").agg(
        F.when(F.bool_or(has & ~F.array_contains("allowed", F.col("unit"))), "selection_wrong_group")
        .when(F.bool_or("slot_back"), "selection_source_order")
        .when(F.first("required") & (F.count("unit") == 0), F.when(F.first("branch") != COMMON, "selection_branch").otherwise("selection_missing_group"))
        .alias("why")
    )
    per_slot = per_slot.filter("why IS NOT NULL").groupBy("query_id").agg(F.min_by("why", "slot_no").alias("slot_reason"))
    seen = _seen(picked)
    # The contract as the units of the catalogue would have it.
    own = units.filter("selectable").groupBy("query_id", "group_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "unit"))), lambda x: x["unit"]).alias("own"))
    set_out = slots.select("query_id", "group_key", "allowed", F.lit(True).alias("asked"))
    drift = set_out.join(own, ["query_id", "group_key"], "full").groupBy("query_id").agg(F.bool_or(F.col("asked").isNull() | (F.coalesce("own", F.array().cast("array<string>")) != F.col("allowed"))).alias("drift"))

    rows = p.join(per_slot, "query_id", "left").join(seen, "query_id", "left").join(drift, "query_id", "left").join(requirements(plans, units), "query_id", "left")
    needed = F.filter("slots", lambda s: s["required"])
    groups = F.transform(needed, lambda s: s["group_key"])
    branches = F.array_distinct(F.filter(F.transform(needed, lambda s: s["branch"]), lambda b: b != COMMON))
    other = F.when(F.col("procedure"), ~F.col("covered") | (groups != F.col("covered_groups")) | (branches != F.col("covered_branches"))).otherwise(
        F.col("covered") | F.exists("slots", lambda s: ~s["required"] | (s["branch"] != COMMON))
    )
    reason = (
        F.when(~F.col("schema"), "selection_schema")
        .when(F.col("n") == 0, "selection_empty")
        .when(F.col("n") > F.col("most"), "selection_limit")
        .when(F.col("n_distinct") < F.col("n"), "selection_duplicate_id")
        .when(F.col("n_unknown") > 0, "selection_unknown_id")
        .when(F.col("n_closed") > 0, "selection_non_selectable")
        .when(F.col("slot_reason").isNotNull(), F.col("slot_reason"))
        .when(F.col("drift") | other, "selection_contract_drift")
        .when(F.col("back"), "selection_source_order")
        .when(F.col("procedure"), _covering())
        .otherwise("")
    )
    return rows.select("query_id", F.coalesce("n", F.lit(0)).alias("n_selected"), reason.alias("reason"))


# Of facets that begin at the same unit the more particular come first.
_PARTICULAR = {"phase_action": 0, "phase": 1, "group": 2, "branch": 2, "action_family": 3, "query_action": 4}


def facets(plans: DataFrame, units: DataFrame) -> DataFrame:
    """query_id, slot, slot_no, kind, key, eligible: what each broad procedure has to cover, a slot for each, in the order of
    the first unit that covers it. A facet that no unit covers comes last and has no eligible unit."""
    broad = plans.filter("procedure AND broad AND covered").select("query_id", "covered_groups", "covered_branches", "actions")
    needed = broad.join(requirements(plans, units), "query_id")

    def of(kind: str, keys) -> Column:
        return F.transform(keys, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    kinds = {"group": "covered_groups", "branch": "covered_branches", "phase": "phase_slots", "phase_action": "action_slots", "action_family": "all_families", "query_action": "actions"}
    asked = needed.select("query_id", F.explode(F.concat(*[of(kind, F.col(c)) for kind, c in kinds.items()])).alias("f")).select("query_id", "f.*")
    able = units.join(broad, "query_id").filter(F.col("required") & F.col("selectable") & F.array_contains("covered_groups", F.col("group_key")))
    place = F.concat_ws("/", "branch", "phase")
    own = F.concat(
        of("group", F.array("group_key")),
        of("branch", F.array("branch")),
        of("phase", F.array(place)),
        of("phase_action", F.transform("families", lambda x: F.concat_ws("/", place, x))),
        of("action_family", F.col("families")),
        of("query_action", F.filter("actions", lambda a: F.contains(F.col("text"), a))),
    )
    covers = able.select("query_id", "unit", "ord", F.explode(F.array_distinct(own)).alias("f")).select("query_id", "unit", "ord", "f.*")
    rows = asked.distinct().join(covers, ["query_id", "kind", "key"], "left").groupBy("query_id", "kind", "key").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("ord", "unit")))), lambda x: x["unit"]).alias("eligible"), F.min("ord").alias("first"))
    particular = F.element_at(F.create_map(*[F.lit(x) for kv in _PARTICULAR.items() for x in kv]), F.col("kind"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("first").asc_nulls_last(), particular, "kind", "key"))
    return rows.withColumn("slot_no", number).select("query_id", F.concat(F.lit("f"), "slot_no").alias("slot"), "slot_no", "kind", "key", "eligible")


def validate_facets(plans: DataFrame, slots: DataFrame, units: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, n_selected, reason for answers with one unit for each facet; slots as facets() gives them.

    The checks in order: the shape; slot by slot a value that is no text or a unit that can't cover the facet; no slot at all;
    too many, unknown and unselectable units; slots that aren't those of the plan and the units; units out of order, by the
    first slot of each; then what is uncovered, as in validate().
    """
    p = plans.join(answers.select("query_id", "raw"), "query_id", "left").withColumn("v", F.try_parse_json("raw"))
    top, given = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$.facet_selections", "map<string,variant>")
    asked = slots.groupBy("query_id").agg(F.array_sort(F.collect_list("slot")).alias("names"), F.array_sort(F.collect_list(F.struct("slot_no", "slot", "eligible"))).alias("slots"))
    p = p.join(asked, "query_id", "left").withColumn("given", given)
    names = F.coalesce("names", F.array().cast("array<string>"))
    p = p.withColumn("schema", F.coalesce((F.array_join(F.map_keys(top), "/") == "facet_selections") & (F.array_sort(F.map_keys("given")) == names), F.lit(False)))
    said = p.filter("schema").select("query_id", F.explode("slots").alias("s"), "given").select("query_id", "s.*", F.element_at("given", F.col("s.slot")).alias("value"))
    said = said.select("query_id", "slot_no", "eligible", F.when(F.coalesce(F.schema_of_variant("value") == "STRING", F.lit(False)), F.try_variant_get("value", "$", "string")).alias("unit"))
    wrong = F.when(F.col("unit").isNull(), "selection_schema").when(~F.array_contains("eligible", F.col("unit")), "selection_wrong_facet")
    first_wrong = said.withColumn("why", wrong).filter("why IS NOT NULL").groupBy("query_id").agg(F.min_by("why", "slot_no").alias("slot_reason"))
    picked = said.filter("unit IS NOT NULL").groupBy("query_id", "unit").agg(F.min("slot_no").alias("slot_no")).join(_known(units), ["query_id", "unit"], "left")
    picked = picked.withColumn("back", F.coalesce(F.lag("ord").over(Window.partitionBy("query_id").orderBy("slot_no")) > F.col("ord"), F.lit(False)))
    theirs, ours = slots.select("query_id", "slot_no", "slot", "kind", "key", "eligible"), facets(plans, units).select("query_id", "slot_no", F.struct("slot", "kind", "key", "eligible").alias("ours"))
    drift = theirs.select("query_id", "slot_no", F.struct("slot", "kind", "key", "eligible").alias("theirs")).join(ours, ["query_id", "slot_no"], "full").groupBy("query_id").agg(F.bool_or(~F.equal_null("theirs", "ours")).alias("drift"))
    rows = p.select("query_id", "schema", "covered_groups", "covered_branches", "actions", "most").join(first_wrong, "query_id", "left").join(_seen(picked), "query_id", "left").join(drift, "query_id", "left").join(requirements(plans, units), "query_id", "left")
    reason = (
        F.when(~F.col("schema"), "selection_schema")
        .when(F.col("slot_reason").isNotNull(), F.col("slot_reason"))
        .when(F.coalesce("n", F.lit(0)) == 0, "selection_empty")
        .when(F.col("n") > F.col("most"), "selection_limit")
        .when(F.col("n_unknown") > 0, "selection_unknown_id")
        .when(F.col("n_closed") > 0, "selection_non_selectable")
        .when(F.coalesce("drift", F.lit(False)), "selection_contract_drift")
        .when(F.col("back"), "selection_source_order")
        .otherwise(_covering())
    )
    return rows.select("query_id", F.coalesce("n", F.lit(0)).alias("n_selected"), reason.alias("reason"))
