"""Whether the evidence found for a question is enough to answer from: the first of twelve reasons against it, or `supported`.

questions  query_id, kind, clarify, domain, scoped (boolean: one document is chosen and may stand for the domain), text, branches,
           entities, documents (arrays: what is asked for), least (documents at least)
evidence   query_id, doc_id, group_key, branch, position (in the evidence), idx (in the source), text, section, seed, complete,
           procedural, headed (booleans; headed: the section is the heading of the aspect asked for)

A question without evidence has no topic. Null texts and sections are empty. Repeated rows are repeats of evidence. Empty tables
give an empty result; evidence without a question and columns of other names are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import anchors, clean

#: Stands before what is asked in addition.
FURTHER = " / 추가 질문: "
# Actions whose absence from the evidence of a named thing counts, with the words that stand for each.
ACTIONS = {"세척": ["세척", "irrigation"], "irrigation": ["세척", "irrigation"], "소독": ["소독"], "교체": ["교체"]}


def _any_of(words: list[str], text: Column) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(F.lower(text), F.lit(word))
    return out


def sufficiency(questions: DataFrame, evidence: DataFrame, aspects: list[tuple[str, str]]) -> DataFrame:
    """query_id, sufficient, reason. aspects: patterns of what a question asks for and of what then has to be in the evidence.

    A question that names one branch is answered from that and from what holds for all. All facts are sums and sets of a
    question's rows, taken in one exchange beside that of the join.
    """
    q = questions.select("query_id", "kind", "clarify", "domain", "scoped", F.coalesce("text", F.lit("")).alias("q"), F.array_distinct("branches").alias("branches"), "entities", "documents", "least")
    q = q.withColumn("now", F.element_at(F.split("q", FURTHER), -1))
    e = evidence.select("query_id", "doc_id", "group_key", "branch", "position", "idx", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("section", F.lit("")).alias("section"), "seed", "complete", "procedural", "headed")
    e = e.join(q.select("query_id", "branches", "kind"), "query_id")
    kept = (F.size("branches") != 1) | (F.col("branch") == "common") | F.array_contains("branches", F.col("branch"))
    e = e.withColumn("kept", kept)
    before = F.lag("idx").over(Window.partitionBy("query_id", "group_key").orderBy("position"))
    e = e.withColumn("ordered", F.coalesce(F.col("idx") >= before, F.lit(True)))
    told = F.when((F.col("kind") == "purpose") & F.col("headed"), F.concat_ws("\n", "text", "section")).otherwise(F.col("text"))
    own = lambda c: F.when(F.col("kept"), c)
    facts = e.groupBy("query_id").agg(
        F.bool_or("seed").alias("seeded"),
        F.collect_set(own(F.col("branch"))).alias("got_branches"),
        F.bool_and(own(F.col("complete"))).alias("complete"),
        F.bool_or(own(F.col("procedural"))).alias("procedural"),
        F.bool_and(own(F.col("ordered"))).alias("ordered"),
        (F.count_if("kept") - F.count_distinct(own(F.concat_ws("|", "branch", F.lower(clean(F.col("text"))))))).alias("repeats"),
        F.array_distinct(F.flatten(F.collect_list(own(anchors(F.concat_ws(" ", "text", "section")))))).alias("got_entities"),
        F.collect_set(own(F.col("doc_id"))).alias("got_documents"),
        *[F.bool_or(own(told.rlike(f"(?i){support}"))).alias(f"aspect{i}") for i, (_, support) in enumerate(aspects)],
        *[F.bool_or(own(_any_of(words, F.col("text")))).alias(f"action{i}") for i, words in enumerate(ACTIONS.values())],
    )
    rows = q.join(facts, "query_id", "left")
    no = F.lit(False)
    without = lambda c: ~F.coalesce(F.col(c), no)
    aspect, action = no, no
    for i, (request, _) in enumerate(aspects):
        aspect = aspect | (F.col("now").rlike(f"(?i){request}") & without(f"aspect{i}"))
    for i, word in enumerate(ACTIONS):
        action = action | (F.contains(F.lower("now"), F.lit(word)) & without(f"action{i}"))
    lost = lambda a, b: F.size(F.array_except(a, b)) > 0
    procedure = F.col("kind") == "procedure"
    named = F.size("entities") > 0
    reason = (
        F.when(F.col("clarify") | (F.col("domain") == "out_of_scope") | ((F.col("domain") != "hospital") & ~F.col("scoped")), "domain_or_clarification")
        .when(without("seeded"), "no_topic_evidence")
        .when((F.size("branches") == 1) & lost("branches", "got_branches"), "missing_requested_branch")
        .when((F.col("kind") == "comparison") & (F.size("branches") == 2) & lost("branches", "got_branches"), "missing_comparison_branch")
        .when(~F.col("complete"), "incomplete_semantic_block")
        .when(procedure & without("procedural"), "missing_procedure_unit")
        .when(procedure & ~F.col("ordered"), "procedure_source_order")
        .when(procedure & (F.col("repeats") > 0), "duplicate_evidence")
        .when(aspect, "missing_requested_aspect")
        .when(named & lost("entities", "got_entities"), "missing_entity")
        .when(named & action, "missing_action")
        .when((F.size("got_documents") < F.col("least")) | lost("documents", "got_documents"), "missing_document")
        .otherwise("supported")
    )
    return rows.select("query_id", (reason == "supported").alias("sufficient"), reason.alias("reason"))
