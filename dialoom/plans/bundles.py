"""Queries over plans of dialogues, made from the heads of the conversations, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import blueprint as b
from dialoom.operators import planning, quality
from dialoom.operators import questions as q
from dialoom.operators import turns as t
from dialoom.plans import reference
from dialoom.plans.problems import _number
from dialoom.plans.reference import W_F, W_T, features_of, placed_of, questions_of, turns_of
from dialoom.session import checkpoint, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _heads(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "conversation_head").where("conversation_id is not null and session_count > 0")
    return known.groupBy(F.col("conversation_id").alias("scenario")).agg(F.min("session_count").alias("sessions"), F.min("speaker_a").alias("first"), F.min("speaker_b").alias("second"), F.min("started_at").alias("started_at"))


def _budget():
    return F.col("sessions") * 8 + F.col("sessions") % 3


_H = "h AS (SELECT conversation_id AS scenario, min(session_count) AS sessions, min(speaker_a) AS first, min(speaker_b) AS second, min(started_at) AS started_at FROM conversation_head WHERE conversation_id IS NOT NULL AND session_count > 0 GROUP BY ALL)"
_SCRIPTS = "scripts AS (SELECT scenario, CAST(session AS INTEGER) AS session, CAST(total // sessions + CASE WHEN session <= total % sessions THEN 1 ELSE 0 END AS INTEGER) AS turn_count FROM (SELECT *, sessions * 8 + sessions % 3 AS total, unnest(range(1, sessions + 1)) AS session FROM h))"
_STAGES = """stages AS (SELECT scenario, k AS stage_no, 'stage_' || k AS stage_id, range(lo, greatest(hi, lo) + 1) AS span FROM (
  SELECT *, CAST(round_even((k - 1) * sessions / n, 0) AS BIGINT) + 1 AS lo, CAST(round_even(k * sessions / n, 0) AS BIGINT) AS hi FROM (SELECT *, least(3, sessions) AS n, unnest(range(1, least(3, sessions) + 1)) AS k FROM h)))"""


@query(f"WITH {_H}, {_STAGES} SELECT scenario, stage_id, span[1] AS first_session, span[len(span)] AS last_session FROM stages")
def stage_spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last session of each stage when sessions are spread evenly."""
    return b.stages_of(_heads(spark, d)).select("scenario", "stage_id", F.element_at("session_span", 1).cast("bigint").alias("first_session"), F.element_at("session_span", -1).cast("bigint").alias("last_session"))


@query(f"""WITH {_H}, {_SCRIPTS}, {_STAGES}, held AS (SELECT scenario, s, min(stage_no) AS k FROM (SELECT scenario, stage_no, unnest(span) AS s FROM stages) GROUP BY ALL)
SELECT c.scenario, c.session, c.turn_count, 'stage_' || coalesce(held.k, least(c.session, 3)) AS stage_id, CASE WHEN coalesce(held.k, least(c.session, 3)) % 2 = 1 THEN 'tense' END AS state,
  strftime(TIMESTAMP '2024-03-10 10:00:00' + to_days(CAST((c.session - 1) * 7 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS starts FROM scripts c LEFT JOIN held ON c.scenario = held.scenario AND c.session = held.s""")
def session_plans(spark: SparkSession, d: str) -> DataFrame:
    """Planned sessions with their stage, the state of its arc and their start."""
    heads = _heads(spark, d)
    stages = b.stages_of(heads)
    scripts = b.stage_of_session(b.scripts_of(heads, _budget()), stages)
    arcs = stages.where("stage_no % 2 = 1").select("scenario", "stage_id", F.lit("tense").alias("state"))
    return scripts.join(arcs, ["scenario", "stage_id"], "left").select("scenario", "session", "turn_count", "stage_id", "state", F.date_format(b.session_start(F.col("session")), "yyyy-MM-dd HH:mm:ss").alias("starts"))


@query(f"""WITH {_H}, v AS (SELECT *, unnest([24, 48, 96]) AS total FROM h), s AS (SELECT *, unnest(range(1, sessions + 1)) AS session FROM v)
SELECT scenario, total, CAST(session AS INTEGER) AS session, CAST(total // sessions + CASE WHEN session <= total % sessions THEN 1 ELSE 0 END AS INTEGER) AS turn_count FROM s""")
def turn_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The same plans under three turn budgets."""
    heads = _heads(spark, d)
    parts = [b.scripts_of(heads, F.lit(n)).select("scenario", F.lit(n).alias("total"), "session", "turn_count") for n in (24, 48, 96)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SESSIONS = "realised AS (SELECT conversation_id AS scenario, session, row_number() OVER (PARTITION BY conversation_id ORDER BY session) AS position, n_turns FROM (SELECT conversation_id, session, count(*) AS n_turns FROM turns GROUP BY ALL) WHERE conversation_id IN (SELECT scenario FROM h))"


@query(W_T + f""", {_H}, {_SCRIPTS}, {_SESSIONS}, z AS (SELECT r.*, c.turn_count FROM realised r JOIN scripts c ON r.scenario = c.scenario AND r.position = c.session),
tot AS (SELECT h.scenario, coalesce(a.n, 0) AS n, coalesce(a.t, 0) AS t, p.n AS pn, p.t AS pt FROM h LEFT JOIN (SELECT scenario, count(*) AS n, sum(n_turns) AS t FROM realised GROUP BY ALL) a USING (scenario) LEFT JOIN (SELECT scenario, count(*) AS n, sum(turn_count) AS t FROM scripts GROUP BY ALL) p USING (scenario))
SELECT 'session_count_differs' AS rule, scenario, CAST(n AS VARCHAR) AS row_key FROM tot WHERE n <> pn UNION ALL SELECT 'turn_total_differs', scenario, CAST(t AS VARCHAR) FROM tot WHERE t <> pt
UNION ALL SELECT 'turn_count_differs', scenario, CAST(session AS VARCHAR) FROM z WHERE n_turns <> turn_count UNION ALL SELECT 'session_out_of_order', scenario, CAST(session AS VARCHAR) FROM z WHERE session <> position""")
def conversation_against_plan(spark: SparkSession, d: str) -> DataFrame:
    """Conversations that differ from their plan in sessions, order or turns."""
    heads = _heads(spark, d)
    realised = t.sessions(turns_of(spark, d)).select(F.col("conversation_id").alias("scenario"), "session", (F.col("sessions_before") + 1).alias("position"), "n_turns")
    return b.conversation_against_plan(realised.join(heads.select("scenario"), "scenario", "left_semi"), b.scripts_of(heads, _budget()), heads)


_EVENTS = "ev AS (SELECT DISTINCT c.conversation_id AS scenario, CAST(session_no AS INTEGER) AS session, e AS event_id FROM (SELECT *, unnest(notes_for_dataset_builder.linked_event_ids) AS e FROM conversation) c WHERE conversation_id IN (SELECT scenario FROM h) AND e IS NOT NULL AND session_no IS NOT NULL)"


def _events(spark: SparkSession, d: str, heads: DataFrame) -> DataFrame:
    named = table(spark, d, "conversation").select(F.col("conversation_id").alias("scenario"), F.col("session_no").cast("int").alias("session"), F.explode("notes_for_dataset_builder.linked_event_ids").alias("event_id"))
    return named.where("event_id is not null and session is not null").distinct().join(heads.select("scenario"), "scenario", "left_semi")


@query(f"""WITH {_H}, {_SCRIPTS}, {_STAGES}, {_EVENTS}, sums AS (SELECT scenario, sum(turn_count) AS t, count(*) AS n FROM scripts GROUP BY ALL), sp AS (SELECT scenario, stage_id, unnest(span) AS s FROM stages),
ec AS (SELECT scenario, session, count(*) AS n FROM ev GROUP BY ALL)
SELECT 'turn_total_differs' AS rule, h.scenario, CAST(h.sessions * 8 AS VARCHAR) AS row_key FROM h JOIN sums USING (scenario) WHERE sums.t <> h.sessions * 8
UNION ALL SELECT 'session_without_stage', c.scenario, CAST(c.session AS VARCHAR) FROM scripts c WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.scenario = c.scenario AND sp.s = c.session)
UNION ALL SELECT 'event_of_unknown_session', e.scenario, e.event_id FROM ev e WHERE NOT EXISTS (SELECT 1 FROM scripts c WHERE c.scenario = e.scenario AND c.session = e.session)
UNION ALL SELECT 'too_few_events', c.scenario, CAST(c.session AS VARCHAR) FROM scripts c LEFT JOIN ec USING (scenario, session) WHERE coalesce(ec.n, 0) < CASE WHEN c.turn_count >= 10 THEN 2 ELSE 1 END
UNION ALL SELECT 'too_few_turns', scenario, CAST(session AS VARCHAR) FROM scripts WHERE turn_count < 2
UNION ALL SELECT 'event_id_twice', scenario, event_id FROM ev GROUP BY ALL HAVING count(*) > 1""")
def plan_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules broken by the plans and the events that turns name (turn totals are asked to be eight a session)."""
    heads = _heads(spark, d)
    totals = heads.select("scenario", "sessions", (F.col("sessions") * 8).alias("turns"))
    return b.plan_violations(b.scripts_of(heads, _budget()), b.stages_of(heads), _events(spark, d, heads), totals)


@query(f"""WITH {_H}, {_SCRIPTS}, {_EVENTS}, e AS (SELECT scenario, session, event_id, row_number() OVER (PARTITION BY scenario, session ORDER BY event_id) - 1 AS no FROM ev),
w AS (SELECT scenario, session, unnest(range(0, CASE WHEN turn_count >= 16 THEN 3 WHEN turn_count >= 10 THEN 2 ELSE 1 END)) AS no FROM scripts)
SELECT w.scenario, w.session, CAST(w.no AS INTEGER) AS event_no, coalesce(e.event_id, CASE WHEN w.session % 4 = 0 THEN 'Topic ' || w.session WHEN TRUE THEN 'session ' || w.session || ' leaves a concrete trace for later memory questions' END) AS description, e.event_id IS NULL AS supplied
FROM w LEFT JOIN e ON w.scenario = e.scenario AND w.session = e.session AND w.no = e.no""")
def events_supplemented(spark: SparkSession, d: str) -> DataFrame:
    """Events of each planned session, missing ones made up from topics."""
    from pyspark.sql import Window

    heads = _heads(spark, d)
    scripts = b.scripts_of(heads, _budget())
    order = Window.partitionBy("scenario", "session").orderBy("event_id")
    events = _events(spark, d, heads).select("scenario", "session", (F.row_number().over(order) - 1).cast("int").alias("event_no"), F.col("event_id").alias("description"))
    every = scripts.where("session % 4 = 0").select("scenario", "session", F.explode(F.array(F.lit(0), F.lit(1))).alias("topic_no"))
    topics = every.withColumn("topic", F.when(F.col("topic_no") == 0, F.concat(F.lit(" Topic "), "session")).otherwise(F.concat(F.lit("TOPIC "), "session")))
    return b.supplemented(scripts, events, topics)


@query(f"""WITH {_H}, n AS (SELECT conversation_id AS scenario, count(*) AS questions FROM qa GROUP BY ALL), c AS (SELECT h.scenario, sessions, sessions * 2 - sessions % 3 AS turns, 3 AS stages, coalesce(questions, 0) AS questions FROM h LEFT JOIN n USING (scenario))
SELECT scenario, unnest([x FOR x IN [CASE WHEN turns < 2 * sessions THEN 'too_few_turns_per_session' END, CASE WHEN stages > sessions THEN 'more_stages_than_sessions' END, CASE WHEN questions > 2 * turns THEN 'too_many_questions' END] IF x IS NOT NULL]) AS rule FROM c""")
def config_violations(spark: SparkSession, d: str) -> DataFrame:
    """Settings of conversations that do not go together."""
    heads, asked = _heads(spark, d), table(spark, d, "qa").groupBy(F.col("conversation_id").alias("scenario")).agg(F.count("*").alias("questions"))
    n = F.col("sessions")
    configs = heads.join(asked, "scenario", "left").select("scenario", n, (n * 2 - n % 3).alias("turns"), F.lit(3).alias("stages"), F.coalesce("questions", F.lit(0)).alias("questions"))
    return b.config_violations(configs)


_TYPES = ["judgment", "retrieval", "explanation", "modality_missing", "modality_ambiguous"]


@query("""WITH p AS (SELECT unit_key, CASE WHEN json_valid(task_layer) THEN json(task_layer) END AS j FROM all_units WHERE task_layer IS NOT NULL),
e AS (SELECT unit_key, CASE WHEN j IS NULL THEN {'path': '<root>', 'problem': 'not readable'} WHEN json_type(j) <> 'OBJECT' THEN {'path': '<root>', 'problem': 'no object'}
  WHEN coalesce(json_type(j -> '$.memory_level'), 'NULL') = 'NULL' THEN {'path': 'memory_level', 'problem': 'missing'} WHEN json_type(j -> '$.memory_level') <> 'VARCHAR' THEN {'path': 'memory_level', 'problem': 'wrong type'}
  WHEN (j ->> '$.memory_level') NOT IN ('Level 0', 'Level 1', 'Level 2', 'Level 3') THEN {'path': 'memory_level', 'problem': 'value not allowed'}
  WHEN coalesce(json_type(j -> '$.options'), 'NULL') NOT IN ('NULL', 'ARRAY') THEN {'path': 'options', 'problem': 'wrong type'}
  WHEN coalesce(json_type(j -> '$.question_text'), 'NULL') = 'NULL' THEN {'path': 'question_text', 'problem': 'missing'} WHEN json_type(j -> '$.question_text') <> 'VARCHAR' THEN {'path': 'question_text', 'problem': 'wrong type'}
  WHEN coalesce(json_type(j -> '$.question_type'), 'NULL') = 'NULL' THEN {'path': 'question_type', 'problem': 'missing'} WHEN json_type(j -> '$.question_type') <> 'VARCHAR' THEN {'path': 'question_type', 'problem': 'wrong type'}
  WHEN (j ->> '$.question_type') NOT IN ('judgment', 'retrieval', 'explanation', 'modality_missing', 'modality_ambiguous') THEN {'path': 'question_type', 'problem': 'value not allowed'} END AS f FROM p)
SELECT unit_key, f.path AS path, f.problem AS problem FROM e WHERE f IS NOT NULL""")
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """First error of each unit's task layer against its schema."""
    members = {"question_text": ("STRING", None, True), "question_type": ("STRING", _TYPES, True), "memory_level": ("STRING", [f"Level {i}" for i in range(4)], True), "options": ("ARRAY", None, False)}
    return b.schema_violations(table(spark, d, "all_units"), "unit_key", "task_layer", members)


@query(W_T + f""", a AS (SELECT DISTINCT conversation_id, {_number("dia_id", 1)} AS s, {_number("dia_id", 2)} AS n FROM annotation WHERE {_number("dia_id", 1)} IS NOT NULL),
c AS (SELECT t.conversation_id, count(*) AS n_turns, count(a.s) AS n_annotated FROM turns t LEFT JOIN a ON t.conversation_id = a.conversation_id AND t.session = a.s AND t.turn = a.n GROUP BY ALL)
SELECT conversation_id, n_turns, n_annotated, CAST(ceil(n_turns / 4) AS BIGINT) AS wanted FROM c WHERE n_annotated < ceil(n_turns / 4)""")
def thin_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with fewer annotated turns than a quarter of their turns."""
    from dialoom.functions.ids import turn_numbers

    n = turn_numbers(F.col("dia_id"))
    told = table(spark, d, "annotation").select("conversation_id", n["session"].alias("session"), n["turn"].alias("turn")).where("session is not null").distinct().withColumn("__a", F.lit(1))
    counts = turns_of(spark, d).join(told, ["conversation_id", "session", "turn"], "left").groupBy("conversation_id").agg(F.count("*").alias("n_turns"), F.count("__a").alias("n_annotated"))
    return counts.withColumn("wanted", F.ceil(F.col("n_turns") / 4).cast("bigint")).where("n_annotated < wanted")


@query(W_F + " SELECT qa_key, CASE WHEN memory_level = 'Level 3' AND NOT early_evidence THEN 'level3_without_wide_span' WHEN memory_level = 'Level 3' AND n_evidence_sessions < 2 THEN 'level3_in_one_session' ELSE 'level2_in_one_session' END AS rule FROM features WHERE (memory_level = 'Level 3' AND (NOT early_evidence OR n_evidence_sessions < 2)) OR (memory_level = 'Level 2' AND n_evidence_sessions < 2)")
def level_span_violations(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose level claims a wider span of evidence than they have."""
    return q.level_spans(features_of(spark, d))


_RULES = {"annotation": "annotation_violations", "question": "question_violations", "unit": "unit_violations"}


@query(f"SELECT entity, rule, n FROM ({reference.ORACLE_SQL['conversation_violation_counts']})" + "".join(f" UNION ALL SELECT '{e}', rule, count(*) FROM ({reference.ORACLE_SQL[name]}) GROUP BY ALL" for e, name in _RULES.items()))
def scenario_violations(spark: SparkSession, d: str) -> DataFrame:
    """All rules over a scenario at once: violations per entity and rule."""
    placed = checkpoint(placed_of(spark, d))  # every rule reads the turns
    every = [
        quality.conversation_violations(placed, table(spark, d, "conversation_head")), quality.annotation_violations(table(spark, d, "annotation").where("conversation_id is not null and dia_id is not null"), placed),
        quality.question_violations(q.features(questions_of(spark, d), placed)), quality.unit_violations(table(spark, d, "all_units"), q.latest(table(spark, d, "qa")), placed),
    ]
    return quality.counted(every)


@query(f"""WITH {_H}, {_SCRIPTS}, s AS (SELECT scenario, count(*) AS n, sum(turn_count) AS t FROM scripts GROUP BY ALL)
SELECT scenario, 'demo/scenario_' || lpad(CAST(no AS VARCHAR), CAST(greatest(3, length(CAST(no AS VARCHAR))) AS INTEGER), '0') AS dir, 'Scenario ' || lpad(CAST(no AS VARCHAR), CAST(greatest(3, length(CAST(no AS VARCHAR))) AS INTEGER), '0') || ': ' || first || ' x ' || second || ' | ' || n || ' sessions | ' || t || ' turns | 24 questions' AS line,
  (no - 1) % 7 AS persona FROM (SELECT *, CAST(regexp_extract(scenario, '([0-9]+)$', 1) AS BIGINT) AS no FROM h JOIN s USING (scenario)) WHERE first IS NOT NULL AND second IS NOT NULL""")
def scenario_lines(spark: SparkSession, d: str) -> DataFrame:
    """A folder, a line of summary and a persona (in turn) for each scenario."""
    heads = _heads(spark, d).where("first is not null and second is not null")
    sums = b.scripts_of(heads, _budget()).groupBy("scenario").agg(F.count("*").alias("n"), F.sum("turn_count").alias("t"))
    no = F.regexp_extract("scenario", "([0-9]+)$", 1).cast("bigint")
    return heads.join(sums, "scenario").select("scenario", b.scenario_dir("demo", no).alias("dir"), b.summary_line(no, F.col("first"), F.col("second"), F.col("n"), F.col("t"), F.lit(24)).alias("line"), planning.persona_index(no, F.lit(7)).alias("persona"))


@query(W_T + f""", {_H} SELECT t.conversation_id, t.dia_id, strftime(h.started_at + to_seconds(75 * (t.session_pos - 1)), '%Y-%m-%dT%H:%M:%S') AS made FROM turns t JOIN h ON t.conversation_id = h.scenario WHERE h.started_at IS NOT NULL AND t.turn % 5 = 0""")
def turn_times_made(spark: SparkSession, d: str) -> DataFrame:
    """Times of turns that lack one (every fifth is taken to): the start and a fixed step for each turn before."""
    from dialoom.operators.prefix import salted_join

    heads = _heads(spark, d).where("started_at is not null").select(F.col("scenario").alias("conversation_id"), F.col("started_at").cast("timestamp_ntz").alias("start"))
    rows = salted_join(placed_of(spark, d).where("turn % 5 = 0"), heads, ["conversation_id"], F.col("dia_id"))
    return rows.select("conversation_id", "dia_id", b.turn_time(F.col("start"), F.col("session_pos") - 1, F.lit(" ")).alias("made"))
