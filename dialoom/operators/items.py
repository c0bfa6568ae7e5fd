"""Dataset items from exported units, answers against gold, contexts as text, units still to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import rules, text


def task(column: str, key: str) -> Column:
    """Member of a JSON object text; null where the text is no readable object."""
    readable = F.startswith(F.ltrim(column), F.lit("{")) & F.try_parse_json(F.col(column)).isNotNull()
    return F.when(readable, F.get_json_object(column, f"$.{key}"))


def source_marker(stem: str, index: Column) -> Column:
    """Where an item comes from: file, place, conversation, question, anchor."""
    name = lambda *cs, other: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(other))
    return F.concat_ws(
        "::", F.lit(stem), index.cast("string"), name(F.col("conversation_id"), other="conversation"),
        name(F.col("question_id"), F.col("unit_id"), other="item"), name(F.col("anchor.dia_id"), other="no-anchor"),
    )


def item_id(dataset: str) -> Column:
    """Stable id of a unit in a dataset: readable parts and a hash of what it is."""
    identity = text.short_hash(F.col("unit_id"), F.col("conversation_id"), F.col("question_id"), F.col("anchor.dia_id"), F.col("anchor.text"), task("task_layer", "question_text"))
    conversation = F.coalesce(F.when(F.col("conversation_id") != "", F.col("conversation_id")), F.lit("conversation"))
    named = F.coalesce(F.when(F.col("question_id") != "", F.col("question_id")), F.when(F.col("unit_id") != "", F.col("unit_id")), F.lit("item"))
    return F.concat_ws("__", text.slug(F.lit(dataset)), text.slug(conversation), text.slug(named), identity)


def short_level(level: Column) -> Column:
    return F.when(F.startswith(level, F.lit("Level ")), F.trim(F.replace(level, F.lit("Level "), F.lit("")))).otherwise(F.coalesce(level, F.lit("")))


def short_modality(condition: Column) -> Column:
    """Short name of a modality condition; unknown ones stay."""
    plain = F.lower(F.trim(F.coalesce(condition, F.lit("normal"))))
    plain = F.when(plain == "", "normal").otherwise(plain)
    known = F.create_map(*[F.lit(x) for pair in rules.MODALITY_SHORT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), plain)


def dataset_items(units: DataFrame, dataset: str, stem: str, index: Column) -> DataFrame:
    """(item_id, input, expected, metadata): one item per unit."""
    t = lambda key: task("task_layer", key)
    shown = F.struct(*[F.col(f"anchor.{c}").alias(n) for c, n in (("speaker", "speaker"), ("text", "text"), ("spoken_at", "timestamp"), ("voice_style", "voice_style"))])
    views = F.struct(task("benchmark_views", "session_local_context").alias("session_local_context"), task("benchmark_views", "full_history_context").alias("full_history_context"),
                     F.col("history_evidence").alias("gold_evidence_context"), task("benchmark_views", "modality_conditioned_views").alias("modality_conditioned_views"))
    return units.select(
        item_id(dataset).alias("item_id"),
        F.struct("unit_id", "question_id", t("question_text").alias("question_text"), t("options").alias("options"), shown.alias("anchor"), views.alias("benchmark_views")).alias("input"),
        F.struct(F.col("question_id").alias("qid"), "unit_id", "conversation_id", F.col("anchor.dia_id").alias("anchor_dia_id"), source_marker(stem, index).alias("source_marker"),
                 t("content_type").alias("content"), t("question_type").alias("qtype"), short_level(t("memory_level")).alias("memory"), t("reasoning_structure").alias("reasoning"),
                 short_modality(t("modality_condition")).alias("modality")).alias("metadata"),
    )


def upserted(existing: DataFrame, fresh: DataFrame, key: str = "item_id") -> DataFrame:
    """The dataset with fresh items put in place of those of the same id; of fresh ones sent twice one stays."""
    new = fresh.dropDuplicates([key])
    return existing.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def exact_match(predicted: Column, gold: Column, acceptable: Column, options: Column) -> Column:
    """1 or 0 for questions with options: the answer's key is that of the gold or an acceptable answer; null without options."""
    named = F.filter(F.concat(F.array(gold), F.coalesce(acceptable, F.array().cast("array<string>"))), lambda x: F.trim(x) != "")
    hit = F.array_contains(F.transform(named, text.answer_key), text.answer_key(F.coalesce(predicted, F.lit(""))))
    return F.when(F.coalesce(F.size(options), F.lit(0)) > 0, F.when(hit, 1.0).otherwise(0.0))


def turn_line(turn: Column, time: str = "spoken_at") -> Column:
    """'[time] speaker: text', with a line for the voice where there is one."""
    voice = F.when(F.coalesce(turn["voice_style"], F.lit("")) != "", F.concat(F.lit("\nvoice_style: "), turn["voice_style"])).otherwise("")
    speaker = F.when(F.coalesce(turn["speaker"], F.lit("")) != "", turn["speaker"]).otherwise("Unknown")
    return F.concat(F.lit("["), F.coalesce(turn[time], F.lit("")), F.lit("] "), speaker, F.lit(": "), F.coalesce(turn["text"], F.lit("")), voice)


def transcript(turns: Column, time: str = "spoken_at") -> Column:
    """An array of turns as text, a blank line between them."""
    return F.coalesce(F.array_join(F.transform(turns, lambda t: turn_line(t, time)), "\n\n"), F.lit(""))


def with_evidence(history: Column, evidence: Column) -> Column:
    """History and, if there is any, the evidence that is highlighted."""
    return F.when(evidence != "", F.concat(F.lit("[Full Conversation History]\n"), history, F.lit("\n\n[Highlighted Evidence]\n"), evidence)).otherwise(history)


def context_of(policy: Column, views: dict[str, Column]) -> Column:
    """The prepared context that a policy names; an unknown policy has none."""
    return F.coalesce(*[F.when(policy == name, value) for name, value in views.items()])


def query_text(question: Column, anchor: Column, options: Column) -> Column:
    """What is searched for: question, anchor and options, empty parts left out."""
    parts = F.array(question, anchor, F.array_join(options, " "))
    return F.trim(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "))


def session_key(time: Column) -> Column:
    """The day of a time, or the whole text where there is no T, or session_unknown."""
    given = F.coalesce(time, F.lit(""))
    return F.when(F.contains(given, F.lit("T")), F.substring_index(given, "T", 1)).when(given != "", given).otherwise("session_unknown")


def to_repeat(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units whose question and anchor text are not among those done."""
    keyed = units.withColumn("__q", F.trim(F.coalesce(task("task_layer", "question_text"), F.lit("")))).withColumn("__a", F.trim(F.coalesce("anchor.text", F.lit(""))))
    keys = done.select(F.trim(F.coalesce("question_text", F.lit(""))).alias("__q"), F.trim(F.coalesce("anchor_text", F.lit(""))).alias("__a")).distinct()
    return keyed.join(keys, ["__q", "__a"], "left_anti").drop("__q", "__a")
