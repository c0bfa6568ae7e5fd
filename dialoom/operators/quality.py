"""Constraint rules over conversations, annotations, questions and units.

A rule is a row-producing query: all violations come out as (rule, entity, conversation_id, row_key),
nothing stops at the first one. ``assert_valid`` turns them into an error where a caller wants that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import rules, text
from dialoom.functions.ids import turn_numbers
from dialoom.operators import questions as q
from dialoom.operators import turns as t
from dialoom.operators.prefix import salted_join


def flagged(rows: DataFrame, entity: str, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per broken rule; ``checks`` say what is wrong (null counts as fine)."""
    broken = F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks.items()]))
    return rows.select(F.explode(broken).alias("rule"), F.lit(entity).alias("entity"), "conversation_id", F.col(key).cast("string").alias("row_key"))


def conversation_violations(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """Turn order, speakers, modality and voice rules; target speakers of the heads."""
    pair = heads.groupBy("conversation_id").agg(F.min("speaker_a").alias("a"), F.min("speaker_b").alias("b"))
    rows = salted_join(placed, pair, ["conversation_id"], F.col("dia_id"), "left")
    has_audio, has_text = F.array_contains("modality_available", "audio"), F.array_contains("modality_available", "text")
    turns = flagged(rows, "turn", "dia_id", {
        "unknown_speaker": ~F.col("speaker").isin("") & (F.col("speaker") != F.col("a")) & (F.col("speaker") != F.col("b")),
        "no_timestamp": F.coalesce(F.trim("spoken_at"), F.lit("")) == "",
        "no_text_modality": ~F.coalesce(has_text, F.lit(False)),
        "no_voice_style": F.col("voice_style").isNull(),
        "voice_style_leak": F.size(text.leak_labels(F.col("voice_style"))) > 0,
        "audio_id_mismatch": F.col("audio_id").isNotNull() & ~F.startswith("audio_id", F.concat(F.lit("D"), F.col("session"), F.lit("_"), F.col("turn"))),
        "audio_without_id": F.col("audio_id").isNull() & F.coalesce(has_audio, F.lit(False)),
    })
    gaps = t.index_gaps(placed).select(F.lit("index_gap").alias("rule"), F.lit("turn").alias("entity"), "conversation_id", F.col("dia_id").alias("row_key"))
    twice = placed.where("turn_index is not null").groupBy("conversation_id", "turn_index").count().where("count > 1").select(
        F.lit("index_twice").alias("rule"), F.lit("turn").alias("entity"), "conversation_id", F.col("turn_index").cast("string").alias("row_key")
    )
    target = flagged(heads.dropDuplicates(["conversation_id", "speaker_a", "speaker_b", "target_speaker"]), "conversation", "conversation_id", {
        "target_speaker_unknown": F.coalesce((F.col("target_speaker") != F.col("speaker_a")) & (F.col("target_speaker") != F.col("speaker_b")), F.lit(True)),
    }).distinct()
    return reduce(DataFrame.unionByName, [turns, gaps, twice, target])


def annotation_violations(annotations: DataFrame, placed: DataFrame) -> DataFrame:
    """Links of annotations to turns, evidence and quotes; level against the need of history.

    Every row is checked; rows sent twice unchanged are one. Ids are compared by session and turn number.
    """
    n = turn_numbers(F.col("dia_id"))
    rows = annotations.distinct().withColumn("session", n["session"]).withColumn("turn", n["turn"])
    at = placed.select("conversation_id", "session", "turn", F.col("speaker").alias("__speaker"), F.col("dia_id").alias("__id"))
    ids = F.filter(F.coalesce("evidence_turn_ids", F.array().cast("array<string>")), lambda x: x.isNotNull())
    quoted = F.coalesce(F.transform("evidence_turn_quotes", lambda x: x["dia_id"]), F.array().cast("array<string>"))
    level = text.level_label(F.col("memory_dependency_level"), "Level 0")
    # evidence and quotes meet their turns in long form, one row per id
    marked = rows.withColumn("__row", F.xxhash64(*rows.columns))
    quotes = F.coalesce(F.transform("evidence_turn_quotes", lambda x: F.struct(x["dia_id"].alias("id"), x["speaker"].alias("by"))), F.array().cast("array<struct<id:string,by:string>>"))
    long = marked.select("__row", "conversation_id", F.explode(F.concat(F.transform(ids, lambda x: F.struct(x.alias("id"), F.lit(None).cast("string").alias("by"), F.lit(True).alias("e"))),
                         F.transform(quotes, lambda x: F.struct(x["id"].alias("id"), x["by"].alias("by"), F.lit(False).alias("e"))))).alias("x"))
    m = turn_numbers(F.col("x.id"))
    met = long.select("__row", "conversation_id", m["session"].alias("session"), m["turn"].alias("turn"), "x.by", "x.e").join(at, ["conversation_id", "session", "turn"], "left")
    links = met.groupBy("__row").agg(F.max(F.col("e") & F.col("__id").isNull()).alias("__lost"), F.max(~F.col("e") & (F.col("by") != F.col("__speaker"))).alias("__misquoted"))
    own = marked.join(at, ["conversation_id", "session", "turn"], "left").join(links, "__row", "left")
    return flagged(own, "annotation", "dia_id", {
        "turn_missing": F.col("__id").isNull(),
        "speaker_mismatch": F.col("speaker") != F.col("__speaker"),
        "reasoning_unknown": ~F.coalesce(text.reasoning(F.col("reasoning_structure")).isin(*rules.REASONING), F.lit(False)),
        "no_evidence": F.size(ids) == 0,
        "evidence_missing": F.col("__lost"),
        "quote_speaker_mismatch": F.col("__misquoted"),
        "quote_outside_evidence": F.size(F.array_except(quoted, ids)) > 0,
        "level0_needs_history": (level == "Level 0") & F.coalesce("historical_memory_required", F.lit(False)),
    })


def question_violations(features: DataFrame) -> DataFrame:
    """Anchor, evidence, level, options, adversarial and wording rules of questions."""
    reasons = q.invalid_reasons(features)
    return flagged(features, "question", "qa_key", {
        "anchor_missing": F.col("anchor_id").isNull(),
        "reasoning_unknown": ~F.col("reasoning_structure").isin(*rules.REASONING),
        "no_evidence": F.col("n_evidence") == 0,
        "evidence_missing": F.col("n_found") < F.col("n_evidence"),
        "level3_without_prior": (F.col("memory_level") == "Level 3") & (F.col("n_prior") == 0),
        "adversarial_type_missing": F.col("adversarial_flag") & F.col("adversarial_type").isNull(),
        "adversarial_type_without_flag": F.col("type_without_flag"),
        "judgment_without_options": (F.col("question_type") == "judgment") & (F.size("answer_options") == 0),
        **{name: F.array_contains(reasons, name) for name in ("future_evidence", "replacement_cue", "fabricated_prior", "explanatory_retrieval", "names_session_or_turn")},
    })


def unit_violations(units: DataFrame, latest_questions: DataFrame, placed: DataFrame) -> DataFrame:
    """Units against their question and the turns."""
    n = turn_numbers(F.col("anchor.dia_id"))
    own = units.select(
        "unit_key", "unit_id", "conversation_id", "question_id", n["session"].alias("session"), n["turn"].alias("turn"),
        F.size(F.filter(F.coalesce("history_evidence", F.array()), lambda x: x.isNotNull())).alias("n_history"),
    )
    asked = latest_questions.select("conversation_id", "question_id", turn_numbers(F.col("anchor_dia_id")).alias("__n"), F.size(F.coalesce("evidence_turn_ids", F.array().cast("array<string>"))).alias("__evidence"), F.lit(True).alias("__known"))
    at = placed.select("conversation_id", "session", "turn", F.lit(True).alias("__at"))
    rows = own.join(asked, ["conversation_id", "question_id"], "left").join(at, ["conversation_id", "session", "turn"], "left")
    return flagged(rows, "unit", "unit_key", {
        "question_missing": F.col("__known").isNull(),
        "anchor_turn_missing": F.col("__at").isNull(),
        "anchor_differs": (F.col("__n.session") != F.col("session")) | (F.col("__n.turn") != F.col("turn")),
        "evidence_length_differs": F.col("n_history") != F.col("__evidence"),
    })


def counted(violations: list[DataFrame]) -> DataFrame:
    """Violations of several checks per entity and rule."""
    return reduce(DataFrame.unionByName, violations).groupBy("entity", "rule").agg(F.count("*").alias("n"))


def assert_valid(violations: DataFrame) -> None:
    """Raise on the first few violations, if there are any."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError("; ".join(f"{r['rule']}: {r['entity']} {r['row_key']}" for r in some))
