"""Self-contained units: question, anchor, evidence, contexts, retrieval candidates, masked views.

Contexts live as spans until the sink. ``session_views`` materialises the session-local part (a
session is small); the full history goes out as a span unless ``history_limit`` asks for its last
turns, so that a long conversation does not multiply the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.ids import turn_numbers
from dialoom.operators import questions as q
from dialoom.operators import turns as t

PART_UNITS = 256


def condition_key() -> Column:
    """The masked view a question asks for, null for none."""
    kind, condition = F.col("question_type"), F.col("modality_condition")
    named = F.replace(condition, F.lit("removed"), F.lit("missing"))
    return F.when(~kind.isin("modality_missing", "modality_ambiguous") & (condition == "normal"), F.lit(None)).when(
        condition != "normal", named
    ).when(kind == "modality_missing", "voice_style_missing").otherwise("voice_style_ambiguous")


def masked(voice: Column, condition: Column, is_target: Column) -> Column:
    """Voice description under a condition: only the anchor and the turn before it are masked."""
    return (
        F.when(is_target & (condition == "voice_style_missing"), "unavailable")
        .when(is_target & (condition == "voice_style_ambiguous") & voice.isNotNull(), "unclear")
        .otherwise(voice)
    )


def session_views(questions: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of the session-local context of each question, plain and masked."""
    asked = q.anchored(questions, placed).where("anchor_id is not null").select(
        "qa_key", "conversation_id", "session", F.col("turn").alias("anchor_turn"), condition_key().alias("condition")
    )
    rows = asked.join(placed.select("conversation_id", "session", "turn", "dia_id", "speaker", "text", "spoken_at", "voice_style", "session_pos"), ["conversation_id", "session"])
    target = (F.col("turn") == F.col("anchor_turn")) | ((F.col("anchor_turn") > 1) & (F.col("turn") == F.col("anchor_turn") - 1))
    return rows.where("turn <= anchor_turn").withColumn("masked_voice", F.when(F.col("condition").isNotNull(), masked(F.col("voice_style"), F.col("condition"), target)))


def history_views(questions: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows of the full-history context of each question, plain and masked."""
    asked = q.anchored(questions, placed).where("anchor_id is not null").withColumn("condition", condition_key())
    anchors = asked.select("qa_key", "conversation_id", F.col("session").alias("__session"), F.col("turn").alias("__turn"), "condition", F.col("anchor_pos").alias("history_pos"))
    said = placed.select("conversation_id", "session", "turn", "dia_id", "speaker", "text", "spoken_at", "voice_style", "history_pos")
    rows = t.prefix_rows(anchors, said, "qa_key", "__session", "__turn", "condition")  # the anchor's facts come along: a join with them would move every context row
    target = (F.col("session") == F.col("__session")) & ((F.col("turn") == F.col("__turn")) | ((F.col("__turn") > 1) & (F.col("turn") == F.col("__turn") - 1)))
    masked_voice = F.when(F.col("condition").isNotNull(), masked(F.col("voice_style"), F.col("condition"), target))
    return rows.withColumn("masked_voice", masked_voice).drop("__session", "__turn")


def candidates(questions: DataFrame, placed: DataFrame) -> DataFrame:
    """Retrieval candidates of each question."""
    asked = q.anchored(questions, placed).where("anchor_id is not null").select("qa_key", "conversation_id", "session", F.col("anchor_pos").alias("history_pos"))
    return t.retrieval_candidates(asked, placed, "qa_key")


def evidence_rows(questions: DataFrame, placed: DataFrame) -> DataFrame:
    """Evidence turns of each question in their listed order; ids without a turn are left out."""
    return q.evidence(questions, placed).where("dia_id is not null")


def units(questions: DataFrame, annotations: DataFrame, placed: DataFrame, history_limit: int = 0, whole: bool = False) -> DataFrame:
    """One nested row per question whose anchor exists.

    ``whole`` puts the full history, its masked view and the retrieval candidates into the rows, as an
    export needs them; a row is then as large as the history of its anchor.
    """
    base = q.anchored(questions, placed).where("anchor_id is not null").withColumn("condition", condition_key())
    proof = evidence_rows(questions, placed).groupBy("qa_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "dia_id", F.col("evidence_speaker").alias("speaker"), F.col("evidence_text").alias("text"), "turn_index"))).alias("history_evidence")
    )
    view = F.struct("turn", "dia_id", "speaker", "text", "spoken_at", "voice_style", "masked_voice", "session_pos")
    local = session_views(questions, placed).groupBy("qa_key").agg(F.array_sort(F.collect_list(view)).alias("session_local"))
    # annotations are matched by session and turn number; of several the last in a fixed order counts
    n = turn_numbers(F.col("dia_id"))
    told = F.struct("underlying_emotion", "relation_state", "memory_dependency_level")
    first = annotations.where(n.isNotNull()).select("conversation_id", F.format_string("D%d:%d", n["session"], n["turn"]).alias("anchor_id"), told.alias("annotation")).groupBy("conversation_id", "anchor_id").agg(F.max("annotation").alias("annotation"))
    spans = t.context_spans(base.select("qa_key", "conversation_id", "session", "turn"), placed).select("qa_key", "n_full", "n_local", "n_prior", "n_windows")
    out = (
        base.join(proof, "qa_key", "left").join(local, "qa_key", "left").join(spans, "qa_key", "left").join(first, ["conversation_id", "anchor_id"], "left")
        .select(
            F.concat(F.lit("U_"), F.col("question_id")).alias("unit_id"), "qa_key", "conversation_id", "question_id",
            F.struct(F.col("anchor_id").alias("dia_id"), F.col("anchor_text").alias("text"), F.col("anchor_index").alias("turn_index")).alias("anchor"),
            "history_evidence", "annotation",
            F.struct("content_type", "question_type", "memory_level", "reasoning_structure", "question_text", "answer_options", "modality_condition", "adversarial_flag", "adversarial_type").alias("task_layer"),
            F.struct("gold_answer", "acceptable_answers", "critical_event_ids", "evidence_turn_ids", "gold_rationale", "key_explanation_points").alias("gold"),
            "session_local", F.struct(F.lit(1).cast("bigint").alias("first_pos"), F.col("anchor_pos").alias("last_pos")).alias("full_history_span"),
            "n_full", "n_local", "n_prior", "n_windows", "condition", F.col("session").alias("__session"), F.col("turn").alias("__turn"),
        )
    )
    if history_limit:
        rows = t.span_rows(base.select("qa_key", "conversation_id", F.col("anchor_pos").alias("history_pos")), placed, "qa_key", history_limit)
        recent = rows.groupBy("qa_key").agg(F.array_sort(F.collect_list(F.struct("history_pos", "dia_id", "speaker", "text"))).alias("recent_history"))
        out = out.join(recent, "qa_key", "left")
    if whole:
        out = _with_contexts(out, placed)
    return out.drop("__session", "__turn")


def _with_contexts(built: DataFrame, placed: DataFrame) -> DataFrame:
    """The units with full_history_context and retrieval_candidates (null if there is none).

    The turns of a conversation are packed once and go to every part of its units; a unit cuts its contexts
    out of them in its own row. Nothing is shuffled after that: what moves grows with turns and units, not
    with the contexts. A task holds the turns of one conversation, as a row of a unit does anyway.
    """
    wanted, parts = t.parted(built.withColumn("history_pos", F.col("full_history_span.last_pos")), "qa_key", PART_UNITS)
    said = F.struct("history_pos", "session", "turn", "session_pos", "dia_id", "speaker", "text", "spoken_at", "voice_style")
    there = t.packed(placed, parts, said)
    each = wanted.join(there.hint("merge"), ["conversation_id", "__part"])

    def shown(x: Column) -> Column:
        target = (x["session"] == F.col("__session")) & ((x["turn"] == F.col("__turn")) | ((F.col("__turn") > 1) & (x["turn"] == F.col("__turn") - 1)))
        voice = F.when(F.col("condition").isNotNull(), masked(x["voice_style"], F.col("condition"), target))
        return F.struct(*[x[c].alias(c) for c in ("history_pos", "dia_id", "speaker", "text", "spoken_at", "voice_style")], voice.alias("masked_voice"))

    def item(no: int, x: Column) -> Column:
        return F.struct(F.lit(no).cast("bigint").alias("item_no"), *[x[c].alias(c) for c in ("dia_id", "speaker", "text", "spoken_at", "voice_style")])

    def window(x: Column) -> Column:
        after = F.get("__before", x["history_pos"].cast("int"))  # the turn behind x, places counting from 1
        return F.when(after["session_pos"] % 2 == 0, F.array(item(0, x), item(1, after))).otherwise(F.array(item(0, x)))

    pos = F.col("history_pos").cast("int")
    cut = each.withColumn("__before", F.slice("__turns", F.lit(1), pos - 1))
    windows = F.transform(F.filter("__before", lambda x: x["session_pos"] % 2 == 1), window)
    full = F.transform(F.slice("__turns", F.lit(1), pos), shown)
    return cut.withColumn("full_history_context", full).withColumn("retrieval_candidates", F.when(pos > 1, windows)).drop("history_pos", "__turns", "__before", "__part")
