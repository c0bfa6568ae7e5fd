"""Orphan references: child keys whose parent row is missing, deleted or late.

Parents and children are tagged and united in long form, grouped by key with partial aggregation,
and only the keys that lack a good parent go on. A key named by a third of all rows therefore costs
one row per map task before the shuffle. The suspect keys are written once; the children meet them in
a sort-merge join of two plain shuffles, which adaptive execution splits where a key is hot (an
aggregation between shuffle and join would forbid that), or in a broadcast join where the suspect
keys are small by measured size.

Defined cases: null and blank references are no case; an id that names no session and turn is
'missing'; a null conversation never matches; a null ``is_deleted`` counts as not deleted; a null
arrival time on either side is never late; repeated rows give one result row per reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions.ids import is_blank, turn_numbers
from dialoom.session import checkpoint


def turn_references(qa: DataFrame) -> DataFrame:
    """One row per visible reference: qa_key, conversation, field, place, parsed numbers, arrival, period."""
    refs = F.concat(
        F.array(F.struct(F.lit("anchor_dia_id").alias("f"), F.lit(0).alias("p"), F.col("anchor_dia_id").alias("v"))),
        F.coalesce(
            F.transform(
                "evidence_turn_ids",
                lambda x, i: F.struct(F.lit("evidence_turn_ids").alias("f"), (i + 1).alias("p"), x.alias("v")),
            ),
            F.array().cast("array<struct<f:string,p:int,v:string>>"),
        ),
    )
    return (
        qa.select(
            "qa_key",
            F.col("conversation_id").alias("conv"),
            F.col("ingested_at").alias("arrived"),
            F.trunc("created_at", "month").alias("period"),
            F.explode(refs).alias("r"),
        )
        .where(~is_blank(F.col("r.v")))
        .withColumn("n", turn_numbers(F.col("r.v")))
        .select(
            "qa_key", "conv", "arrived", "period",
            F.col("r.f").alias("ref_field"), F.col("r.p").alias("ref_pos"),
            F.col("n.session").alias("session"), F.col("n.turn").alias("turn"),
        )
    )


def suspect_keys(children: DataFrame, conversation: DataFrame) -> DataFrame:
    """Keys lacking a parent that is there, not deleted and in time for the earliest child."""
    live = ~F.coalesce(F.col("is_deleted"), F.lit(False))
    parents = (
        conversation.select(
            F.col("conversation_id").alias("conv"),
            turn_numbers(F.col("dia_id")).alias("n"),
            live.alias("live"),
            F.when(live, F.col("ingested_at")).alias("since"),
        )
        .where("n is not null and conv is not null")
        .select(
            "conv", F.col("n.session").alias("session"), F.col("n.turn").alias("turn"),
            F.lit(True).alias("parent"), "live", "since", F.lit(None).cast("timestamp_ntz").alias("used"),
        )
    )
    used = children.where("conv is not null and session is not null").select(
        "conv", "session", "turn",
        F.lit(False).alias("parent"), F.lit(False).alias("live"),
        F.lit(None).cast("timestamp_ntz").alias("since"), F.col("arrived").cast("timestamp_ntz").alias("used"),
    )
    parents = parents.withColumn("since", F.col("since").cast("timestamp_ntz"))
    return (
        parents.unionByName(used)
        .groupBy("conv", "session", "turn")
        .agg(
            F.max("parent").alias("parent"),
            F.max("live").alias("live"),
            F.min("since").alias("since"),
            F.max(~F.col("parent")).alias("named"),
            F.min("used").alias("first_used"),
        )
        .where("named and (not live or since > first_used)")
        .drop("named", "first_used")
    )


def orphan_references(qa: DataFrame, conversation: DataFrame) -> DataFrame:
    """(qa_key, ref_field, ref_pos, state, period) of every reference without a good parent."""
    children = turn_references(qa)
    suspects = checkpoint(suspect_keys(children, conversation))
    keyed = children.where("conv is not null and session is not null")
    state = (
        F.when(~F.col("parent"), "missing")
        .when(~F.col("live"), "deleted")
        .when(F.col("since") > F.col("arrived").cast("timestamp_ntz"), "late")
    )
    found = (
        keyed.join(suspects, ["conv", "session", "turn"])
        .select("qa_key", "ref_field", "ref_pos", state.alias("state"), "period")
        .where("state is not null")
    )
    unreadable = children.where("conv is null or session is null").select(
        "qa_key", "ref_field", "ref_pos", F.lit("missing").alias("state"), "period"
    )
    return found.unionByName(unreadable)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per field, month of creation and state."""
    return (
        orphans.groupBy("ref_field", "period", "state")
        .agg(F.count("*").alias("n_references"), F.countDistinct("qa_key").alias("n_rows"))
        .select("ref_field", F.date_format("period", "yyyy-MM").alias("month"), "state", "n_references", "n_rows")
    )
