"""Repair of turns and annotations: speakers, wording, levels, links, shapes; small list operations.

A conversation's two speakers come from its head (one row per conversation, spread over several keys
where a conversation is hot); speakers of annotations and quotes come from the turns they name, by
one equality join in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import rules, text
from dialoom.functions.ids import turn_numbers
from dialoom.operators import turns as t
from dialoom.operators.prefix import salted_join


def canonical_speaker(value: Column, first: Column, second: Column, blanks: bool = True) -> Column:
    """The name of the side that a label stands for; other labels stay. Blanks are the first side's, if they count."""
    low = F.lower(F.trim(value))
    none = ["", "..."] if blanks else []
    personas = (["teacher persona"], ["student persona"]) if blanks else ([], [])
    mine = low.isin(*none, "teacher", "psychological teacher", *personas[0]) | (low == F.lower(first))
    theirs = low.isin("student", *personas[1]) | (low == F.lower(second))
    return F.when(F.coalesce(mine, F.lit(False)), first).when(F.coalesce(theirs, F.lit(False)), second).otherwise(value)


def canonical_target(value: Column, first: Column, second: Column) -> Column:
    """The target speaker: the first side if named so, else the second."""
    low = F.lower(F.trim(value))
    return F.when(F.coalesce(low.isin("teacher", "psychological teacher") | (low == F.lower(first)), F.lit(False)), first).otherwise(second)


def pairs_of(heads: DataFrame) -> DataFrame:
    """(conversation_id, first, second): the speakers of each conversation."""
    return heads.groupBy("conversation_id").agg(F.coalesce(F.min("speaker_a"), F.lit("Teacher")).alias("first"), F.coalesce(F.min("speaker_b"), F.lit("Student")).alias("second"))


def turns_repaired(placed: DataFrame, heads: DataFrame) -> DataFrame:
    """Turns with canonical speakers, complete indexes and voice descriptions that give nothing away."""
    rows = salted_join(placed, pairs_of(heads), ["conversation_id"], F.col("dia_id"), "left")
    named = rows.withColumn("speaker", F.when(F.col("first").isNull(), F.col("speaker")).otherwise(canonical_speaker(F.col("speaker"), F.col("first"), F.col("second")))).drop("first", "second")
    worded = text.with_voice_reworded(named.withColumn("voice_style", text.nfkc(text.unmangled(F.col("voice_style")))).withColumn("text", text.nfkc("text")), "voice_style")
    filled = t.filled_index(placed).select("conversation_id", "dia_id", "filled_index")
    return worded.join(filled, ["conversation_id", "dia_id"])


def turn_shape(conversation: DataFrame) -> DataFrame:
    """Turns brought to their shape: modalities that belong to them, notes with defaults, and what is missing."""
    has_audio = F.coalesce(F.col("audio_id"), F.lit("")) != ""
    given = F.coalesce("modality_available", F.array(*map(F.lit, ("text", "voice_style", "audio"))))
    full = F.concat(given, F.filter(F.array(*map(F.lit, ("text", "voice_style", "audio"))), lambda x: ~F.coalesce(F.array_contains(given, x), F.lit(False))))
    notes = F.col("notes_for_dataset_builder")
    lacks = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return conversation.select(
        "conversation_id", "dia_id", "speaker", "text", "voice_style", "audio_id",
        F.when(has_audio, full).otherwise(F.array(F.lit("text"), F.lit("voice_style"))).alias("modality_available"),
        F.struct(F.coalesce(notes["linked_event_ids"], F.array().cast("array<string>")).alias("linked_event_ids"),
                 F.coalesce(notes["is_candidate_emotion_anchor"], F.lit(False)).alias("is_candidate_emotion_anchor"),
                 F.coalesce(notes["is_candidate_fact_anchor"], F.lit(False)).alias("is_candidate_fact_anchor")).alias("notes_for_dataset_builder"),
        F.array_compact(F.array(F.when(lacks("text"), "text"), F.when(lacks("voice_style"), "voice_style"))).alias("missing"),
    )


def annotations_repaired(annotations: DataFrame, placed: DataFrame, heads: DataFrame, target_role: str = "student") -> DataFrame:
    """Annotations with level labels, lists never null, speakers of the turns they name, quotes of three members."""
    n = turn_numbers(F.col("dia_id"))
    rows = salted_join(annotations.withColumn("__row", F.xxhash64(*annotations.columns)), pairs_of(heads), ["conversation_id"], F.col("dia_id"), "left")
    at = placed.select("conversation_id", "session", "turn", F.col("speaker").alias("__spoken"))
    own = rows.withColumn("session", n["session"]).withColumn("turn", n["turn"]).join(at, ["conversation_id", "session", "turn"], "left")
    m = turn_numbers(F.col("q.dia_id"))
    quotes = rows.select("__row", "conversation_id", "first", "second", F.posexplode("evidence_turn_quotes").alias("p", "q")).where("q is not null")
    spoken = quotes.withColumn("session", m["session"]).withColumn("turn", m["turn"]).join(at, ["conversation_id", "session", "turn"], "left")
    by = F.coalesce("__spoken", canonical_speaker(F.col("q.speaker"), F.col("first"), F.col("second"), blanks=False))
    # identical rows share their quotes: one of each place is kept
    kept = spoken.groupBy("__row", "p").agg(F.first(F.struct(F.col("q.dia_id").alias("dia_id"), by.alias("speaker"), F.col("q.text_evidence").alias("text_evidence"))).alias("q"))
    rebuilt = kept.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda x: x["q"]).alias("__quotes"))
    empty = F.array().cast("array<string>")
    return own.join(rebuilt, "__row", "left").select(
        "conversation_id", "dia_id",
        F.coalesce("__spoken", canonical_speaker(F.col("speaker"), F.col("first"), F.col("second"), blanks=False)).alias("speaker"),
        text.level_label(F.col("memory_dependency_level"), "Level 0").alias("memory_dependency_level"),
        F.coalesce("critical_event_ids", empty).alias("critical_event_ids"), F.coalesce("evidence_turn_ids", empty).alias("evidence_turn_ids"),
        F.coalesce("__quotes", F.array().cast("array<struct<dia_id:string,speaker:string,text_evidence:string>>")).alias("evidence_turn_quotes"), F.lit(target_role).alias("target_role"),
    )


# ---- lists and maps -----------------------------------------------------------------------------


def strings(values: Column, *fallback: str) -> Column:
    """Trimmed entries that are not blank, or the fallback where none is left."""
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    other = F.array(*map(F.lit, fallback)) if fallback else F.array().cast("array<string>")
    return F.when(F.size(kept) > 0, kept).otherwise(other)


def merged(*lists: Column) -> Column:
    """Entries of several lists, each once, in the order they first come."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))


def once_in_any_case(values: Column) -> Column:
    """Entries that differ in more than case, the first spelling of each."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def without(values: Column, others: Column) -> Column:
    """Entries of the first list that the second lacks, each once."""
    return F.array_except(values, F.coalesce(others, F.array().cast("array<string>")))


def map_over(base: Column, override: Column) -> Column:
    """Two maps as one; where both have a key, the override's value counts."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k)), override)


def merged_settings(base: dict, override: dict) -> dict:
    """Nested settings (driver side): members of the override win, objects are merged member by member."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged_settings(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def compact(rows: DataFrame, *columns: str) -> DataFrame:
    """Only the members that a prompt needs; everything else is pruned at the scan."""
    return rows.select(*columns)


def measurable_points(values: Column, fallback: str = "long-term implicit emotion") -> Column:
    """Canonical measurable points, each once, those about modality left out; the fallback where none is left."""
    known = F.create_map(*[F.lit(x) for pair in rules.MEASURABLE_POINTS.items() for x in pair])
    named = F.transform(strings(values, fallback), lambda x: F.trim(F.coalesce(F.try_element_at(known, F.lower(x)), F.replace(F.replace(F.lower(x), F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" ")))))
    kept = F.array_distinct(F.filter(named, lambda x: (x != "") & ~x.isin("modality missing", "modality ambiguous")))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fallback)))
