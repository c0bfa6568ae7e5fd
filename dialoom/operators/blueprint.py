"""Plans of dialogues: stages over sessions, events per session, start times, and their rules.

Plan tables are long: stages(scenario, stage_id, stage_no, session_span), scripts(scenario, session,
turn_count), events(scenario, event_id, session). Rules return violation rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import rules
from dialoom.operators.planning import even_share, event_count


def default_span(stage_no: Column, stages: Column, sessions: Column) -> Column:
    """Sessions of stage ``stage_no`` (from 1) when sessions are spread evenly, rounded half to even."""
    first = F.bround((stage_no - 1) * sessions / stages).cast("int") + 1
    last = F.greatest(F.bround(stage_no * sessions / stages).cast("int"), first)
    return F.sequence(first, last)


def stage_of_session(scripts: DataFrame, stages: DataFrame) -> DataFrame:
    """Scripts with the first stage whose span holds their session, else the stage of the same number, at most the last."""
    held = stages.select("scenario", "stage_id", "stage_no", F.explode("session_span").alias("session"))
    first = Window.partitionBy("scenario", "session").orderBy("stage_no")
    held = held.withColumn("__r", F.row_number().over(first)).where("__r = 1").select("scenario", "session", F.col("stage_id").alias("__held"))
    last = stages.groupBy("scenario").agg(F.max("stage_no").alias("__last"))
    spare = stages.select("scenario", F.col("stage_no").alias("__no"), F.col("stage_id").alias("__spare"))
    out = scripts.join(held, ["scenario", "session"], "left").join(last, "scenario", "left").withColumn("__no", F.least("session", "__last"))
    return out.join(spare, ["scenario", "__no"], "left").withColumn("stage_id", F.coalesce("__held", "__spare")).drop("__held", "__spare", "__last", "__no")


def padded(raw: DataFrame, wanted: DataFrame, key: str = "no") -> DataFrame:
    """Rows brought to the wanted number per scenario: surplus dropped, missing numbers kept as empty rows."""
    spine = wanted.select("scenario", F.explode(F.sequence(F.lit(1), F.col("wanted"))).alias(key))
    return spine.join(raw, ["scenario", key], "left")


def session_start(session: Column, base: str = "2024-03-10 10:00:00") -> Column:
    """Weekly start times from a base date."""
    return F.expr(f"timestamp_ntz'{base}'") + F.make_dt_interval(days=(session - 1) * 7)


def turn_time(start: Column, array_pos: Column, given: Column, step: float = 75.0) -> Column:
    """The given time, or the session's start plus a fixed step per turn (from 0) where it is blank."""
    made = F.date_format(start + F.make_dt_interval(secs=(array_pos * step).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.coalesce(F.trim(given), F.lit("")) != "", given).otherwise(made)


def without_non_emotions(terms: Column) -> Column:
    """Terms that name an emotion, trimmed, in order; blanks and known other terms are left out."""
    named = F.transform(terms, lambda x: F.trim(x))
    return F.filter(named, lambda x: x.isNotNull() & (x != "") & ~F.replace(F.lower(x), F.lit(" "), F.lit("_")).isin(*rules.NON_EMOTION_TERMS))


def plan_violations(scripts: DataFrame, stages: DataFrame, events: DataFrame, totals: DataFrame) -> DataFrame:
    """(rule, scenario, row_key): totals, coverage, references and minimums of a plan.

    ``totals`` has one row per scenario: sessions, turns.
    """
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), "scenario", key.cast("string").alias("row_key"))
    sums = scripts.groupBy("scenario").agg(F.sum("turn_count").alias("__turns"), F.count("*").alias("__n"))
    against = totals.join(sums, "scenario", "left")
    span = stages.select("scenario", "stage_id", F.explode("session_span").alias("session"))
    counted = scripts.join(events.groupBy("scenario", "session").agg(F.count("*").alias("__events")), ["scenario", "session"], "left")
    least = F.when(F.col("turn_count") >= 10, 2).otherwise(1)
    twice = events.groupBy("scenario", "event_id").count().where("count > 1")
    return reduce(DataFrame.unionByName, [
        row(against.where("__turns is null or __turns <> turns"), "turn_total_differs", F.col("turns")),
        row(against.where("__n is null or __n <> sessions"), "session_count_differs", F.col("sessions")),
        row(scripts.join(span, ["scenario", "session"], "left_anti"), "session_without_stage", F.col("session")),
        row(span.join(scripts, ["scenario", "session"], "left_anti"), "stage_of_unknown_session", F.col("stage_id")),
        row(events.join(scripts, ["scenario", "session"], "left_anti"), "event_of_unknown_session", F.col("event_id")),
        row(counted.where(F.coalesce("__events", F.lit(0)) < least), "too_few_events", F.col("session")),
        row(scripts.where("turn_count < 2"), "too_few_turns", F.col("session")),
        row(twice, "event_id_twice", F.col("event_id")),
    ])


def scripts_of(heads: DataFrame, turns: Column) -> DataFrame:
    """(scenario, session, session_id, turn_count): planned sessions of each scenario, a turn budget dealt evenly.

    ``heads`` has scenario and sessions; another budget gives the same sessions with other turn counts.
    """
    spread = heads.select("scenario", "sessions", turns.alias("__total"), F.explode(F.sequence(F.lit(1), F.col("sessions"))).alias("session"))
    return spread.select("scenario", "session", F.concat(F.lit("S"), "session").alias("session_id"), even_share(F.col("__total"), F.col("sessions"), F.col("session")).cast("int").alias("turn_count"))


def stages_of(heads: DataFrame, count: int = 3) -> DataFrame:
    """(scenario, stage_no, stage_id, session_span): stages with their default spans, no more of them than sessions."""
    numbered = heads.select("scenario", "sessions", F.explode(F.sequence(F.lit(1), F.least(F.lit(count), F.col("sessions")))).alias("stage_no"))
    span = default_span(F.col("stage_no"), F.least(F.lit(count), F.col("sessions")), F.col("sessions"))
    return numbered.select("scenario", "stage_no", F.concat(F.lit("stage_"), "stage_no").alias("stage_id"), span.alias("session_span"))


def first_text(fallback: Column, *given: Column) -> Column:
    """The first given text that is not blank, trimmed, else the fallback."""
    return F.coalesce(*[F.when(F.trim(g) != "", F.trim(g)) for g in given], fallback)


def supplemented(scripts: DataFrame, events: DataFrame, topics: DataFrame) -> DataFrame:
    """(scenario, session, event_no, description, supplied): events of each session, filled up to the number its turns call for.

    ``events`` (scenario, session, event_no from 0, description); ``topics`` (scenario, session, topic_no,
    topic) stand in for missing ones at their own number, each once in any case, then a general phrase.
    """
    first = topics.where(F.trim("topic") != "").groupBy("scenario", "session", F.lower(F.trim("topic")).alias("__k")).agg(F.min_by(F.struct("topic_no", F.trim("topic").alias("topic")), "topic_no").alias("t"))
    place = Window.partitionBy("scenario", "session").orderBy("t.topic_no")
    spare = first.select("scenario", "session", (F.row_number().over(place) - 1).cast("int").alias("event_no"), F.col("t.topic").alias("topic"))
    wanted = scripts.select("scenario", "session", F.explode(F.sequence(F.lit(0), event_count(F.col("turn_count")) - 1)).alias("event_no"))
    rows = wanted.join(events, ["scenario", "session", "event_no"], "left").join(spare, ["scenario", "session", "event_no"], "left")
    general = F.concat(F.lit("session "), "session", F.lit(" leaves a concrete trace for later memory questions"))
    return rows.select("scenario", "session", "event_no", F.coalesce("description", "topic", general).alias("description"), F.col("description").isNull().alias("supplied"))


def conversation_against_plan(sessions: DataFrame, scripts: DataFrame, heads: DataFrame) -> DataFrame:
    """(rule, scenario, row_key): realised sessions against the planned ones, matched by position.

    ``sessions`` (scenario, session, position, n_turns) in their order; ``scripts`` the plan.
    """
    actual = sessions.groupBy("scenario").agg(F.count("*").alias("__n"), F.sum("n_turns").alias("__turns"))
    planned = scripts.groupBy("scenario").agg(F.count("*").alias("__planned"), F.sum("turn_count").alias("__budget"))
    totals = heads.select("scenario").join(actual, "scenario", "left").join(planned, "scenario", "left").na.fill({"__n": 0, "__turns": 0})
    zipped = sessions.join(scripts.select("scenario", F.col("session").alias("position"), "session_id", "turn_count"), ["scenario", "position"])
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), "scenario", key.cast("string").alias("row_key"))
    return reduce(DataFrame.unionByName, [
        row(totals.where("__n <> __planned"), "session_count_differs", F.col("__n")),
        row(totals.where("__turns <> __budget"), "turn_total_differs", F.col("__turns")),
        row(zipped.where("n_turns <> turn_count"), "turn_count_differs", F.col("session")),
        row(zipped.where("session <> position"), "session_out_of_order", F.col("session")),
    ])


def config_violations(configs: DataFrame) -> DataFrame:
    """(rule, scenario): settings that do not go together (columns sessions, turns, stages, questions)."""
    broken = F.array_compact(F.array(
        F.when(F.col("turns") < 2 * F.col("sessions"), "too_few_turns_per_session"), F.when(F.col("stages") > F.col("sessions"), "more_stages_than_sessions"),
        F.when(F.col("questions") > 2 * F.col("turns"), "too_many_questions"),
    ))
    return configs.select("scenario", F.explode(broken).alias("rule"))


def schema_violations(rows: DataFrame, key: str, column: str, members: dict[str, tuple[str, list[str] | None, bool]]) -> DataFrame:
    """(key, path, problem): first error by path of each JSON text against a flat schema.

    ``members``: name -> (type of the value, allowed values or None, required).
    """
    v = F.try_parse_json(column)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    problems = [F.when(v.isNull(), F.struct(F.lit("<root>").alias("path"), F.lit("not readable").alias("problem")))]
    problems.append(F.when(v.isNotNull() & ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.struct(F.lit("<root>").alias("path"), F.lit("no object").alias("problem"))))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    for name, (wanted, allowed, required) in sorted(members.items()):
        given = kind(name)
        absent = given.isNull() | (given == "VOID")
        value = F.try_variant_get(v, f"$.{name}", "string")
        problem = F.when(absent, F.lit("missing") if required else F.lit(None).cast("string")).when(~F.startswith(given, F.lit(wanted)), "wrong type")
        if allowed:
            problem = problem.when(~value.isin(*allowed), "value not allowed")
        problems.append(F.when(is_object & problem.isNotNull(), F.struct(F.lit(name).alias("path"), problem.alias("problem"))))
    first = F.get(F.array_compact(F.array(*problems)), 0)
    return rows.where(F.col(column).isNotNull()).select(key, first.alias("__f")).where("__f is not null").select(key, "__f.path", "__f.problem")


def summary_line(number: Column, first: Column, second: Column, sessions: Column, turns: Column, questions: Column) -> Column:
    """One line that tells what a scenario is."""
    return F.concat(F.format_string("Scenario %03d: ", number), first, F.lit(" x "), second, F.lit(" | "), sessions, F.lit(" sessions | "), turns, F.lit(" turns | "), questions, F.lit(" questions"))


def scenario_dir(batch: str, number: Column) -> Column:
    return F.concat(F.lit(f"{batch}/"), F.format_string("scenario_%03d", number))
