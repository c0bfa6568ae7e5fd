"""Queries over dialogues, questions, annotations, units and events, each with the SQL it must equal.

All outputs are flat; floats are rounded to 6 digits; every ranking has a unique tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import rules, text
from dialoom.functions.ids import turn_numbers
from dialoom.operators import analytics, planning, quality, retrieval, units
from dialoom.operators import questions as q
from dialoom.operators import turns as t
from dialoom.plans.problems import _number
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


# ---- shared inputs -------------------------------------------------------------------------


def turns_of(spark: SparkSession, d: str) -> DataFrame:
    return t.latest(table(spark, d, "conversation"))


def placed_of(spark: SparkSession, d: str) -> DataFrame:
    return t.ordered(turns_of(spark, d))


def questions_of(spark: SparkSession, d: str) -> DataFrame:
    return q.normalized(q.latest(table(spark, d, "qa")))


def features_of(spark: SparkSession, d: str) -> DataFrame:
    return q.features(questions_of(spark, d), placed_of(spark, d))


def scored_of(spark: SparkSession, d: str) -> DataFrame:
    return q.scored(features_of(spark, d))


def _nested(x: str, pairs: list[tuple[str, str]]) -> str:
    for bad, good in pairs:
        x = "replace({}, '{}', '{}')".format(x, bad.replace("'", "''"), good.replace("'", "''"))
    return x


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _token(x: str, fallback: str, aliases: dict[str, str] | None = None) -> str:
    words = rf"regexp_replace(translate(lower({_strip(x)}), '-_', '  '), '[\s\p{{Z}}]+', ' ', 'g')"
    cases = "".join(f" WHEN '{k}' THEN '{v}'" for k, v in (aliases or {}).items())
    named = f"CASE {words}{cases} ELSE {words} END" if cases else words
    return f"CASE WHEN {x} IS NULL OR {_strip(x)} = '' THEN {fallback} ELSE replace({named}, ' ', '_') END"


def _reasoning(x: str) -> str:
    plain = f"translate(lower({_strip(x)}), '_ ', '--')"
    return f"CASE {plain}" + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in rules.REASONING_ALIASES.items() if "_" not in k) + f" ELSE {plain} END"


def _level(x: str, fallback: str) -> str:
    return rf"CASE WHEN regexp_extract(lower({x}), 'level\D*([0-3])', 1) <> '' THEN 'Level ' || regexp_extract(lower({x}), 'level\D*([0-3])', 1) ELSE {fallback} END"


def _any(x: str, marks: list[str]) -> str:
    return "(" + " OR ".join("contains(lower(coalesce({}, '')), '{}')".format(x, m.replace("'", "''")) for m in marks) + ")"


_VISIBLE = r"({x} IS NOT NULL AND regexp_replace({x}, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]', '', 'g') <> '')"

TURNS = f"""
numbered AS (SELECT *, {_number("dia_id", 1)} AS session, {_number("dia_id", 2)} AS turn FROM conversation WHERE conversation_id IS NOT NULL),
versions AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, session, turn ORDER BY ingested_at DESC NULLS LAST, coalesce(is_deleted, false) DESC, text ASC NULLS LAST, speaker ASC NULLS LAST) AS version
             FROM numbered WHERE session IS NOT NULL AND turn IS NOT NULL),
turns AS (SELECT conversation_id, session, turn, 'D' || session || ':' || turn AS dia_id, speaker, spoken_at, CAST(turn_index_global AS BIGINT) AS turn_index,
                 {_nested("text", rules.MOJIBAKE)} AS text, nullif(trim(voice_style), '') AS voice_style, nullif(trim(audio_id), '') AS audio_id, modality_available,
                 row_number() OVER (PARTITION BY conversation_id, session ORDER BY turn) AS session_pos,
                 row_number() OVER (PARTITION BY conversation_id ORDER BY session, turn) AS history_pos
          FROM versions WHERE version = 1 AND NOT coalesce(is_deleted, false))
"""

QUESTIONS = f"""
qversions AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, question_id ORDER BY ingested_at DESC NULLS LAST, qa_key DESC) AS version FROM qa WHERE conversation_id IS NOT NULL AND question_id IS NOT NULL),
questions AS (SELECT qa_key, conversation_id, question_id, anchor_dia_id, question_text, gold_answer,
                     {_token("question_type", "'judgment'", rules.QUESTION_TYPE_ALIASES)} AS question_type, {_token("content_type", "'long_term_implicit_emotion'")} AS content_type,
                     coalesce({_reasoning("reasoning_structure")}, 'direct') AS reasoning_structure, {_level("memory_level", "'Level 0'")} AS memory_level,
                     {_token("modality_condition", "'normal'")} AS modality_condition, coalesce(adversarial_flag, false) AS adversarial_flag,
                     CASE WHEN adversarial_flag THEN {_token("adversarial_type", "NULL")} END AS adversarial_type,
                     NOT coalesce(adversarial_flag, false) AND {_VISIBLE.format(x="adversarial_type")} AS type_without_flag,
                     coalesce(answer_options, []) AS answer_options, coalesce(evidence_turn_ids, []) AS evidence_turn_ids,
                     {_number("anchor_dia_id", 1)} AS session, {_number("anchor_dia_id", 2)} AS turn
              FROM qversions WHERE version = 1),
anchored AS (SELECT q.*, t.dia_id AS anchor_id, t.text AS anchor_text, t.turn_index AS anchor_index, t.history_pos AS anchor_pos, t.session_pos AS anchor_session_pos
             FROM questions q LEFT JOIN turns t ON q.conversation_id = t.conversation_id AND q.session = t.session AND q.turn = t.turn),
listed AS (SELECT qa_key, conversation_id, i - 1 AS pos, evidence_turn_ids[i] AS raw FROM (SELECT *, unnest(range(1, len(evidence_turn_ids) + 1)) AS i FROM questions)),
evidence AS (SELECT e.qa_key, e.conversation_id, e.pos, e.raw, e.s AS session, e.t AS turn, t.dia_id, t.text AS evidence_text, t.speaker AS evidence_speaker, t.turn_index, t.history_pos
             FROM (SELECT *, {_number("raw", 1)} AS s, {_number("raw", 2)} AS t FROM listed WHERE {_VISIBLE.format(x="raw")}) e
             LEFT JOIN turns t ON e.conversation_id = t.conversation_id AND e.s = t.session AND e.t = t.turn)
"""

FEATURES = f"""
facts AS (SELECT e.qa_key, count(*) AS n_evidence, count(e.dia_id) AS n_found, count(*) FILTER (WHERE e.turn_index < a.anchor_index) AS n_prior,
                 count(DISTINCT CASE WHEN e.turn_index < a.anchor_index THEN e.session END) AS n_prior_sessions,
                 coalesce(bool_or(e.turn_index < a.anchor_index AND e.session < a.session), false) AS earlier_session,
                 coalesce(bool_or(e.turn_index > a.anchor_index), false) AS future_evidence, count(DISTINCT e.session) AS n_evidence_sessions,
                 coalesce(bool_or(a.session - e.session >= 2), false) AS early_evidence
          FROM evidence e JOIN anchored a USING (qa_key) GROUP BY ALL),
totals AS (SELECT conversation_id, count(DISTINCT session) AS total_sessions FROM turns GROUP BY ALL),
features AS (SELECT *, anchor_session = total_sessions AS is_last FROM (
  SELECT a.*, coalesce(f.n_evidence, 0) AS n_evidence, coalesce(f.n_found, 0) AS n_found, coalesce(f.n_prior, 0) AS n_prior, coalesce(f.n_prior_sessions, 0) AS n_prior_sessions,
         coalesce(f.n_evidence_sessions, 0) AS n_evidence_sessions, coalesce(f.earlier_session, false) AS earlier_session, coalesce(f.future_evidence, false) AS future_evidence,
         coalesce(f.early_evidence, false) AS early_evidence, coalesce(c.total_sessions, 0) AS total_sessions, coalesce(a.session, -1) AS anchor_session,
         {_any("a.anchor_text", rules.LATE_SUMMARY)} AS late_summary,
         {_any("coalesce(a.anchor_text, '') || ' || ' || coalesce(a.question_text, '') || ' || ' || coalesce(a.gold_answer, '')", rules.OUTCOME)} AS outcome
  FROM anchored a LEFT JOIN facts f USING (qa_key) LEFT JOIN totals c USING (conversation_id)))
"""


def _sum(*parts: tuple[str, int]) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in parts) + ")"


_TWO, _L3, _L2, _L1 = "n_evidence_sessions >= 2", "memory_level = 'Level 3'", "memory_level = 'Level 2'", "memory_level = 'Level 1'"
_LOW, _HOPS = "memory_level IN ('Level 0', 'Level 1')", "reasoning_structure IN ('multi-hop', 'trajectory-based', 'conflict-resolution')"
_SHALLOW = f"(question_type = 'retrieval' AND n_evidence <= 1 AND {_LOW})"
_SPOKEN = "coalesce(anchor_text, '') || ' || ' || coalesce(question_text, '') || ' || ' || coalesce(gold_answer, '')"
_HARD = _sum((_TWO, 3), (f"NOT {_TWO}", -3), (f"{_L3} AND early_evidence", 4), (f"{_L3} AND NOT early_evidence", -6), (f"{_L2} AND {_TWO}", 1), (f"{_L2} AND NOT {_TWO}", -3), (_L1, -2), (_HOPS, 1), ("late_summary", -3), (_SHALLOW, -4))
_FINAL = _sum((_L3, 6), (_L2, 4), (_L1, 1), ("memory_level = 'Level 0'", -1), (f"{_L3} AND NOT early_evidence", -8), (_TWO, 3), (f"NOT {_TWO} AND ({_L2} OR {_L3})", -3), (_HOPS, 2),
              ("reasoning_structure = 'direct'", -1), ("question_type = 'retrieval' AND len(evidence_turn_ids) <= 1", -4), ("late_summary", -4), ("outcome", -4), (f"is_last AND {_LOW}", -2),
              ("is_last AND outcome", -3), ("anchor_session >= 2 AND anchor_session <= greatest(2, total_sessions - 1)", 1))
_EASY = _sum(("is_last AND outcome", 4), ("is_last AND late_summary", 2), (_SHALLOW, 5), (f"question_type = 'judgment' AND is_last AND {_any(_SPOKEN, rules.GENERIC_JUDGMENT)}", 2))
_RESIDUE = _sum((f"{_any('question_text', rules.RESIDUAL)} OR {_any('gold_answer', rules.RESIDUAL)}", 3), (f"{_any('question_text', rules.GROWTH)} OR {_any('gold_answer', rules.GROWTH)}", -2), (_any("question_text", rules.GENERIC_LATE), -1))
_BONUS = _sum(("question_type = 'retrieval'", -2), ("content_type IN ('long_term_implicit_emotion', 'relation_change', 'relation_state')", 1))
SCORED = f"scored AS (SELECT *, {_HARD} AS hard_score, {_FINAL} AS final_score, {_EASY} AS easy_score, {_FINAL} + {_RESIDUE} AS late_score, {_FINAL} + {_BONUS} AS anchor_score FROM features)"

W_T, W_Q = f"WITH {TURNS}", f"WITH {TURNS}, {QUESTIONS}"
W_F, W_S = f"{W_Q}, {FEATURES}", f"{W_Q}, {FEATURES}, {SCORED}"


# ---- turns ----------------------------------------------------------------------------------


@query(W_T + "SELECT conversation_id, session, turn, dia_id, speaker, turn_index, text, voice_style, audio_id FROM turns")
def turns_flat(spark: SparkSession, d: str) -> DataFrame:
    return turns_of(spark, d).select("conversation_id", "session", "turn", "dia_id", "speaker", "turn_index", "text", "voice_style", "audio_id")


@query(W_T + "SELECT conversation_id, dia_id, session_pos, history_pos FROM turns")
def turn_order(spark: SparkSession, d: str) -> DataFrame:
    return placed_of(spark, d).select("conversation_id", "dia_id", "session_pos", "history_pos")


@query(W_T + ", s AS (SELECT conversation_id, session, count(*) AS n, min(turn) AS a, max(turn) AS b FROM turns GROUP BY ALL) SELECT conversation_id, session, n AS n_turns, a AS first_turn, b AS last_turn, CAST(coalesce(sum(n) OVER (PARTITION BY conversation_id ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS turns_before FROM s")
def session_sizes(spark: SparkSession, d: str) -> DataFrame:
    return t.sessions(turns_of(spark, d)).drop("sessions_before")


@query(W_T + "SELECT conversation_id, session, (session_pos - 1) // 2 AS window_no, count(*) AS n_turns, min(history_pos) AS first_pos, max(history_pos) AS last_pos, string_agg(dia_id, ' ' ORDER BY history_pos) AS dia_ids FROM turns GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return t.tumbling_windows(placed_of(spark, d))


@query(W_T + "SELECT a.conversation_id, a.history_pos AS center_pos, count(*) AS n_turns, string_agg(b.dia_id, ' ' ORDER BY b.history_pos) AS dia_ids FROM turns a JOIN turns b ON a.conversation_id = b.conversation_id AND b.history_pos BETWEEN a.history_pos - 2 AND a.history_pos + 2 GROUP BY ALL")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return t.sliding_windows(placed_of(spark, d))


@query(W_T + r"SELECT a.conversation_id, a.history_pos AS center_pos, count(*) AS n_turns, count(*) FILTER (WHERE contains(b.text, '?')) AS n_questions, max(length(b.text)) AS longest FROM turns a JOIN turns b ON a.conversation_id = b.conversation_id AND b.history_pos BETWEEN a.history_pos - 3 AND a.history_pos GROUP BY ALL")
def trailing_window_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the last four turns up to each turn."""
    return t.framed(placed_of(spark, d), 3, 0, F.col("text")).groupBy("conversation_id", "center_pos").agg(
        t.at_center().alias("__at"), F.count("*").alias("n_turns"), F.count_if(F.contains("text", F.lit("?"))).alias("n_questions"), F.max(F.length("text")).cast("bigint").alias("longest")
    ).where("__at").drop("__at")


@query(W_T + ", g AS (SELECT *, coalesce(lag(turn_index) OVER (PARTITION BY conversation_id ORDER BY session, turn), 0) + 1 AS expected FROM turns) SELECT conversation_id, dia_id, turn_index, expected FROM g WHERE turn_index IS NULL OR turn_index <> expected")
def index_gaps(spark: SparkSession, d: str) -> DataFrame:
    return t.index_gaps(placed_of(spark, d))


@query(W_T + """, n AS (SELECT *, CASE WHEN turn % 3 = 1 THEN turn_index END AS given FROM turns),
g AS (SELECT *, max(CASE WHEN given IS NOT NULL THEN history_pos END) OVER (PARTITION BY conversation_id ORDER BY history_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM n)
SELECT g.conversation_id, g.dia_id, coalesce(b.given + g.history_pos - g.at, g.history_pos) AS filled_index FROM g LEFT JOIN n b ON g.conversation_id = b.conversation_id AND g.at = b.history_pos""")
def index_fill(spark: SparkSession, d: str) -> DataFrame:
    """Index counted on from every third turn's own."""
    placed = placed_of(spark, d).withColumn("turn_index", F.when(F.col("turn") % 3 == 1, F.col("turn_index")))
    return t.filled_index(placed).drop("turn_index")


@query(f"SELECT doc_id, {_nested('text', rules.MOJIBAKE)} AS text FROM documents WHERE {_nested('text', rules.MOJIBAKE)} IS DISTINCT FROM text")
def mojibake_repaired(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("__before"), text.unmangled(F.col("text")).alias("text"))
    return docs.where(~F.col("text").eqNullSafe(F.col("__before"))).drop("__before")


@query(W_T + "SELECT conversation_id, dia_id, CASE WHEN turn % 2 = 1 THEN 'first' ELSE 'second' END AS side, CAST(least((session_pos - 1) // greatest(n // 3, 1), 2) AS BIGINT) AS event_no FROM (SELECT *, count(*) OVER (PARTITION BY conversation_id, session) AS n FROM turns)")
def active_events(spark: SparkSession, d: str) -> DataFrame:
    """Side by parity, and the event (of three a session) that each turn belongs to."""
    placed = placed_of(spark, d)
    side = F.when(F.col("turn") % 2 == 1, "first").otherwise("second")
    return placed.select("conversation_id", "dia_id", side.alias("side"), planning.active_event(F.col("session_pos"), F.col("n_turns"), F.lit(3)).cast("bigint").alias("event_no"))


# ---- contexts and units ----------------------------------------------------------------------


@query(W_Q + """, s AS (SELECT conversation_id, session, count(*) AS n FROM turns GROUP BY ALL),
w AS (SELECT *, coalesce(sum((n + 1) // 2) OVER (PARTITION BY conversation_id ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT a.qa_key, a.anchor_pos AS n_full, a.anchor_session_pos AS n_local, a.anchor_pos - 1 AS n_prior, CAST(w.before + a.anchor_session_pos // 2 AS BIGINT) AS n_windows
FROM anchored a JOIN w ON a.conversation_id = w.conversation_id AND a.session = w.session WHERE a.anchor_id IS NOT NULL""")
def context_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    n = turn_numbers(F.col("anchor_dia_id"))
    anchors = questions_of(spark, d).select("qa_key", "conversation_id", n["session"].alias("session"), n["turn"].alias("turn"))
    return t.context_spans(anchors, placed_of(spark, d)).select("qa_key", "n_full", "n_local", "n_prior", F.col("n_windows").cast("bigint").alias("n_windows"))


@query(W_Q + "SELECT a.qa_key, t.history_pos, t.dia_id, t.text FROM anchored a JOIN turns t ON a.conversation_id = t.conversation_id AND t.history_pos BETWEEN a.anchor_pos - 7 AND a.anchor_pos")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """The last eight turns up to each anchor."""
    placed = placed_of(spark, d)
    base = q.anchored(questions_of(spark, d), placed).where("anchor_id is not null")
    rows = t.span_rows(base.select("qa_key", "conversation_id", F.col("anchor_pos").alias("history_pos")), placed, "qa_key", 8)
    return rows.select("qa_key", "history_pos", "dia_id", "text")


_CONDITION = "CASE WHEN question_type NOT IN ('modality_missing', 'modality_ambiguous') AND modality_condition = 'normal' THEN NULL WHEN modality_condition <> 'normal' THEN replace(modality_condition, 'removed', 'missing') WHEN question_type = 'modality_missing' THEN 'voice_style_missing' ELSE 'voice_style_ambiguous' END"


@query(W_Q + f""", c AS (SELECT *, {_CONDITION} AS condition FROM anchored WHERE anchor_id IS NOT NULL)
SELECT c.qa_key, t.dia_id, c.condition, t.voice_style, CASE WHEN c.condition IS NULL THEN NULL WHEN t.turn >= c.turn - 1 AND c.condition = 'voice_style_missing' THEN 'unavailable'
  WHEN t.turn >= c.turn - 1 AND c.condition = 'voice_style_ambiguous' AND t.voice_style IS NOT NULL THEN 'unclear' ELSE t.voice_style END AS masked_voice
FROM c JOIN turns t ON c.conversation_id = t.conversation_id AND c.session = t.session AND t.turn <= c.turn""")
def masked_session_views(spark: SparkSession, d: str) -> DataFrame:
    return units.session_views(questions_of(spark, d), placed_of(spark, d)).select("qa_key", "dia_id", "condition", "voice_style", "masked_voice")


@query(W_Q + "SELECT qa_key, CAST(pos AS INTEGER) AS pos, dia_id, evidence_speaker AS speaker, evidence_text AS text FROM evidence WHERE dia_id IS NOT NULL")
def evidence_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = units.evidence_rows(questions_of(spark, d), placed_of(spark, d))
    return rows.select("qa_key", "pos", "dia_id", F.col("evidence_speaker").alias("speaker"), F.col("evidence_text").alias("text"))


@query(W_Q + """, e AS (SELECT qa_key, count(*) AS n_evidence FROM evidence WHERE dia_id IS NOT NULL GROUP BY ALL), l AS (SELECT a.qa_key, count(*) AS n_local FROM anchored a JOIN turns t ON a.conversation_id = t.conversation_id AND a.session = t.session AND t.turn <= a.turn WHERE a.anchor_id IS NOT NULL GROUP BY ALL)
SELECT 'U_' || a.question_id AS unit_id, a.qa_key, a.anchor_id, a.anchor_text, coalesce(e.n_evidence, 0) AS n_evidence, l.n_local, a.anchor_pos AS last_pos FROM anchored a LEFT JOIN e USING (qa_key) JOIN l USING (qa_key) WHERE a.anchor_id IS NOT NULL""")
def units_built(spark: SparkSession, d: str) -> DataFrame:
    """Units, flattened to what can be compared: sizes of their nested parts."""
    built = units.units(questions_of(spark, d), table(spark, d, "annotation"), placed_of(spark, d))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return built.select(
        "unit_id", "qa_key", F.col("anchor.dia_id").alias("anchor_id"), F.col("anchor.text").alias("anchor_text"),
        F.when(F.col("history_evidence").isNull(), F.lit(0).cast("bigint")).otherwise(size("history_evidence")).alias("n_evidence"),
        size("session_local").alias("n_local"), F.col("full_history_span.last_pos").alias("last_pos"),
    )


@query(r"SELECT unit_key, regexp_replace(regexp_replace(lower(coalesce(unit_id, '')), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, left(sha1(coalesce(unit_id, '') || '||' || coalesce(conversation_id, '') || '||' || coalesce(question_id, '') || '||' || coalesce(anchor.dia_id, '') || '||' || coalesce(anchor.text, '')), 12) AS short_hash FROM all_units")
def unit_item_ids(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "all_units")
    return u.select(
        "unit_key", text.slug(F.coalesce("unit_id", F.lit(""))).alias("slug"),
        text.short_hash(F.col("unit_id"), F.col("conversation_id"), F.col("question_id"), F.col("anchor.dia_id"), F.col("anchor.text")).alias("short_hash"),
    )


@query("SELECT conversation_id || '::' || question_id AS item_id, count(*) AS n, min(CAST(unit_key AS VARCHAR)) AS first FROM all_units WHERE conversation_id IS NOT NULL AND question_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def item_id_collisions(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "all_units").where("conversation_id is not null and question_id is not null")
    return analytics.collisions(u.withColumn("item_id", F.concat_ws("::", "conversation_id", "question_id")), "item_id", F.col("unit_key").cast("string"))


# ---- questions -------------------------------------------------------------------------------


@query(W_Q + "SELECT qa_key, question_type, content_type, reasoning_structure, memory_level, modality_condition, adversarial_flag, adversarial_type FROM questions")
def questions_normalized(spark: SparkSession, d: str) -> DataFrame:
    return questions_of(spark, d).select("qa_key", "question_type", "content_type", "reasoning_structure", "memory_level", "modality_condition", "adversarial_flag", "adversarial_type")


@query(W_F + "SELECT qa_key, memory_level, CASE WHEN anchor_id IS NULL THEN memory_level WHEN n_prior = 0 THEN 'Level 0' WHEN NOT earlier_session THEN 'Level 1' WHEN n_prior_sessions >= 2 OR n_prior >= 3 THEN 'Level 3' ELSE 'Level 2' END AS inferred_level, n_evidence, n_found, n_prior, n_evidence_sessions, early_evidence, future_evidence FROM features")
def memory_levels(spark: SparkSession, d: str) -> DataFrame:
    return features_of(spark, d).select("qa_key", "memory_level", "inferred_level", "n_evidence", "n_found", "n_prior", "n_evidence_sessions", "early_evidence", "future_evidence")


@query(W_S + "SELECT qa_key, hard_score, final_score, easy_score, late_score, anchor_score, late_summary, outcome FROM scored")
def question_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored_of(spark, d).select("qa_key", "hard_score", "final_score", "easy_score", "late_score", "anchor_score", "late_summary", "outcome")


@query(W_S + f""", a AS (SELECT * FROM (SELECT *, CASE WHEN {_VISIBLE.format(x="anchor_dia_id")} THEN row_number() OVER (PARTITION BY conversation_id, anchor_dia_id ORDER BY anchor_score DESC, qa_key) ELSE 1 END AS r FROM scored) WHERE r = 1 AND easy_score < 4),
b AS (SELECT *, CASE WHEN is_last AND outcome THEN row_number() OVER (PARTITION BY conversation_id, is_last AND outcome AND late_score >= 4
        ORDER BY late_score DESC, {_sum(("contains(lower(coalesce(question_text, '')), 'overall demeanor')", 2), ("contains(lower(coalesce(question_text, '')), 'relationship with')", 1), ("contains(lower(coalesce(question_text, '')), 'how has') AND contains(lower(coalesce(question_text, '')), 'evolved')", 1))}, qa_key) END AS lr FROM a),
c AS (SELECT * FROM b WHERE lr IS NULL OR (late_score >= 4 AND lr <= 3)),
e AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, anchor_session ORDER BY final_score DESC, qa_key) = 1 AND anchor_session > 0 AS best FROM c)
SELECT conversation_id, qa_key, pick FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY best DESC, final_score DESC, qa_key) AS pick FROM e) WHERE pick <= 12""")
def questions_curated(spark: SparkSession, d: str) -> DataFrame:
    return q.curated(scored_of(spark, d)).select("conversation_id", "qa_key", "pick")


@query(W_S + "SELECT qa_key, hard_score, hard_score >= 0 OR r <= 4 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY hard_score DESC, memory_level DESC, reasoning_structure DESC, qa_key) AS r FROM scored)")
def questions_kept_or_demoted(spark: SparkSession, d: str) -> DataFrame:
    return q.kept_or_demoted(scored_of(spark, d), 4).select("qa_key", "hard_score", "kept")


_WORDING = r"trim(regexp_replace(lower(coalesce(question_text, '')), '[\s\p{Z}]+', ' ', 'g'))"


@query(W_F + f""", w AS (SELECT qa_key, row_number() OVER (PARTITION BY conversation_id, anchor_dia_id, {_WORDING} ORDER BY qa_key) AS r FROM questions WHERE anchor_dia_id IS NOT NULL AND anchor_dia_id <> '' AND {_WORDING} <> '')
SELECT qa_key, array_to_string([x FOR x IN [
  CASE WHEN ({_LOW} AND reasoning_structure IN ('direct', 'single-hop')) OR (question_type = 'retrieval' AND content_type IN ('near_term_fact', 'long_term_fact') AND memory_level = 'Level 0') THEN 'likely_easy' END,
  CASE WHEN question_type = 'retrieval' AND (content_type = 'near_term_fact' OR memory_level = 'Level 0' OR reasoning_structure = 'direct') THEN 'likely_low_value_retrieval' END,
  CASE WHEN {_any("coalesce(question_text, '') || ' ' || coalesce(anchor_text, '')", rules.CLOSURE)} THEN 'closure_signal' END,
  CASE WHEN w.r > 1 THEN 'likely_duplicate_wording' END, CASE WHEN n_evidence <= 1 AND {_LOW} THEN 'thin_evidence' END] IF x IS NOT NULL], ',') AS tags FROM features LEFT JOIN w USING (qa_key)""")
def curation_tags(spark: SparkSession, d: str) -> DataFrame:
    return q.curation_tags(features_of(spark, d), q.repeated_wording(questions_of(spark, d)))


@query(W_Q + """, p AS (SELECT a.qa_key AS qa_key_a, b.qa_key AS qa_key_b, list_distinct([x FOR x IN a.evidence_turn_ids IF trim(x) <> '']) AS ea, list_distinct([x FOR x IN b.evidence_turn_ids IF trim(x) <> '']) AS eb
  FROM questions a JOIN questions b ON a.conversation_id = b.conversation_id AND a.anchor_dia_id = b.anchor_dia_id AND a.qa_key < b.qa_key)
SELECT qa_key_a, qa_key_b, round(len(list_intersect(ea, eb)) / len(list_distinct(list_concat(ea, eb))), 6) AS overlap FROM p WHERE len(list_intersect(ea, eb)) > 0""")
def evidence_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard overlap of the evidence of questions that share an anchor and an evidence id: postings of ids, no pairs without any."""
    mine = questions_of(spark, d).select("qa_key", "conversation_id", "anchor_dia_id", F.array_distinct(F.filter("evidence_turn_ids", lambda x: F.trim(x) != "")).alias("e"))
    long = mine.select("qa_key", "conversation_id", "anchor_dia_id", F.size("e").alias("n"), F.explode("e").alias("id"))
    a, b = long.alias("a"), long.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("conversation_id", "anchor_dia_id", "id")]
    shared = a.join(b, [*same, F.col("a.qa_key") < F.col("b.qa_key")]).groupBy(F.col("a.qa_key").alias("qa_key_a"), F.col("b.qa_key").alias("qa_key_b")).agg(F.count("*").alias("k"), F.first("a.n").alias("m"), F.first("b.n").alias("n"))
    return shared.select("qa_key_a", "qa_key_b", F.round(F.col("k") / (F.col("m") + F.col("n") - F.col("k")), 6).alias("overlap"))


@query(W_F + r""" SELECT conversation_id, CAST(qa_key AS VARCHAR) AS row_key, rule FROM (SELECT conversation_id, qa_key, unnest([x FOR x IN [
  CASE WHEN anchor_id IS NULL THEN 'anchor_missing' END, CASE WHEN reasoning_structure NOT IN ('direct', 'single-hop', 'multi-hop', 'conflict-resolution', 'trajectory-based') THEN 'reasoning_unknown' END,
  CASE WHEN n_evidence = 0 THEN 'no_evidence' END, CASE WHEN n_found < n_evidence THEN 'evidence_missing' END, CASE WHEN memory_level = 'Level 3' AND n_prior = 0 THEN 'level3_without_prior' END,
  CASE WHEN adversarial_flag AND adversarial_type IS NULL THEN 'adversarial_type_missing' END, CASE WHEN type_without_flag THEN 'adversarial_type_without_flag' END, CASE WHEN question_type = 'judgment' AND len(answer_options) = 0 THEN 'judgment_without_options' END,
  CASE WHEN future_evidence THEN 'future_evidence' END,
  CASE WHEN (question_type IN ('modality_missing', 'modality_ambiguous') OR modality_condition IN ('voice_style_removed', 'text_removed', 'modality_ambiguous', 'voice_style_ambiguous', 'text_ambiguous'))
        AND (contains(lower(coalesce(question_text, '')), 'instead of') OR regexp_matches(lower(coalesce(question_text, '')), '\bif\b.+\bwas described as\b')) THEN 'replacement_cue' END,
  CASE WHEN adversarial_type = 'pseudo_conflict' AND regexp_matches(lower(coalesce(question_text, '')), '\bif\b.+\bhad previously stated\b') THEN 'fabricated_prior' END,
  CASE WHEN question_type = 'retrieval' AND (starts_with(lower(coalesce(question_text, '')), 'explain ') OR contains(lower(coalesce(question_text, '')), ' how does it relate')) THEN 'explanatory_retrieval' END,
  CASE WHEN regexp_matches(coalesce(question_text, ''), '(?i)\bsession\s+\d+\b|\bs\d+\b|\bd\d+:\d+\b') THEN 'names_session_or_turn' END] IF x IS NOT NULL]) AS rule FROM features)""")
def question_violations(spark: SparkSession, d: str) -> DataFrame:
    return quality.question_violations(features_of(spark, d)).select("conversation_id", "row_key", "rule")


@query(W_T + f""", h AS (SELECT conversation_id, min(speaker_a) AS a, min(speaker_b) AS b FROM conversation_head GROUP BY ALL),
v AS (SELECT t.*, h.a, h.b FROM turns t LEFT JOIN h USING (conversation_id)),
r AS (SELECT conversation_id, dia_id AS row_key, unnest([x FOR x IN [
  CASE WHEN speaker <> '' AND speaker <> a AND speaker <> b THEN 'unknown_speaker' END, CASE WHEN coalesce(trim(spoken_at), '') = '' THEN 'no_timestamp' END,
  CASE WHEN NOT coalesce(list_contains(modality_available, 'text'), false) THEN 'no_text_modality' END, CASE WHEN voice_style IS NULL THEN 'no_voice_style' END,
  CASE WHEN regexp_matches(voice_style, '(?i)\\b({'|'.join(rules.LEAK_RULES.values())})\\b') THEN 'voice_style_leak' END,
  CASE WHEN audio_id IS NOT NULL AND NOT starts_with(audio_id, 'D' || session || '_' || turn) THEN 'audio_id_mismatch' END,
  CASE WHEN audio_id IS NULL AND coalesce(list_contains(modality_available, 'audio'), false) THEN 'audio_without_id' END] IF x IS NOT NULL]) AS rule FROM v),
g AS (SELECT *, coalesce(lag(turn_index) OVER (PARTITION BY conversation_id ORDER BY session, turn), 0) + 1 AS expected FROM turns),
all_rows AS (SELECT rule, 'turn' AS entity FROM r UNION ALL SELECT 'index_gap', 'turn' FROM g WHERE turn_index IS NULL OR turn_index <> expected
  UNION ALL SELECT 'index_twice', 'turn' FROM (SELECT conversation_id, turn_index FROM turns WHERE turn_index IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'target_speaker_unknown', 'conversation' FROM (SELECT DISTINCT conversation_id FROM conversation_head WHERE coalesce(target_speaker <> speaker_a AND target_speaker <> speaker_b, true)))
SELECT rule, entity, count(*) AS n FROM all_rows GROUP BY ALL""")
def conversation_violation_counts(spark: SparkSession, d: str) -> DataFrame:
    found = quality.conversation_violations(placed_of(spark, d), table(spark, d, "conversation_head"))
    return found.groupBy("rule", "entity").agg(F.count("*").alias("n"))


@query(W_T + f""", a AS (SELECT *, {_number("dia_id", 1)} AS s, {_number("dia_id", 2)} AS t, [x FOR x IN coalesce(evidence_turn_ids, []) IF x IS NOT NULL] AS ids FROM (SELECT DISTINCT * FROM annotation) WHERE conversation_id IS NOT NULL AND dia_id IS NOT NULL),
named AS (SELECT DISTINCT conversation_id, x, {_number("x", 1)} AS s, {_number("x", 2)} AS t FROM (SELECT conversation_id, unnest(list_concat(ids, [e.dia_id FOR e IN coalesce(evidence_turn_quotes, [])])) AS x FROM a)),
spoken AS (SELECT n.conversation_id, n.x, n.s, n.t, t.speaker FROM named n LEFT JOIN turns t ON n.conversation_id = t.conversation_id AND n.s = t.session AND n.t = t.turn),
facts AS (SELECT a.*, t.dia_id AS at_id, t.speaker AS at_speaker,
  (SELECT count(*) FROM spoken p WHERE p.conversation_id = a.conversation_id AND list_contains(a.ids, p.x) AND p.speaker IS NULL) AS lost,
  (SELECT count(*) FROM (SELECT unnest(a.evidence_turn_quotes) AS e) JOIN spoken p ON p.conversation_id = a.conversation_id AND p.x = e.dia_id WHERE p.speaker <> e.speaker) AS misquoted
  FROM a LEFT JOIN turns t ON a.conversation_id = t.conversation_id AND a.s = t.session AND a.t = t.turn)
SELECT conversation_id, dia_id, rule FROM (SELECT conversation_id, dia_id, unnest([x FOR x IN [CASE WHEN at_id IS NULL THEN 'turn_missing' END, CASE WHEN speaker <> at_speaker THEN 'speaker_mismatch' END,
  CASE WHEN coalesce({_reasoning("reasoning_structure")} NOT IN ('direct', 'single-hop', 'multi-hop', 'conflict-resolution', 'trajectory-based'), true) THEN 'reasoning_unknown' END,
  CASE WHEN len(ids) = 0 THEN 'no_evidence' END, CASE WHEN lost > 0 THEN 'evidence_missing' END,
  CASE WHEN len([e FOR e IN coalesce(evidence_turn_quotes, []) IF e IS NOT NULL AND NOT coalesce(list_contains(ids, e.dia_id), false)]) > 0 THEN 'quote_outside_evidence' END,
  CASE WHEN misquoted > 0 THEN 'quote_speaker_mismatch' END,
  CASE WHEN {_level("memory_dependency_level", "'Level 0'")} = 'Level 0' AND coalesce(historical_memory_required, false) THEN 'level0_needs_history' END] IF x IS NOT NULL]) AS rule FROM facts)""")
def annotation_violations(spark: SparkSession, d: str) -> DataFrame:
    found = quality.annotation_violations(table(spark, d, "annotation").where("conversation_id is not null and dia_id is not null"), placed_of(spark, d))
    return found.select("conversation_id", F.col("row_key").alias("dia_id"), "rule")


@query(W_Q + f""", u AS (SELECT unit_key, conversation_id, question_id, {_number("anchor.dia_id", 1)} AS s, {_number("anchor.dia_id", 2)} AS t, len([x FOR x IN coalesce(history_evidence, []) IF x IS NOT NULL]) AS n FROM all_units),
v AS (SELECT u.*, q.qa_key, q.session AS qs, q.turn AS qt, len(q.evidence_turn_ids) AS nq, t.dia_id FROM u LEFT JOIN questions q ON u.conversation_id = q.conversation_id AND u.question_id = q.question_id LEFT JOIN turns t ON u.conversation_id = t.conversation_id AND u.s = t.session AND u.t = t.turn)
SELECT CAST(unit_key AS VARCHAR) AS row_key, rule FROM (SELECT unit_key, unnest([x FOR x IN [CASE WHEN qa_key IS NULL THEN 'question_missing' END, CASE WHEN dia_id IS NULL THEN 'anchor_turn_missing' END, CASE WHEN qs <> s OR qt <> t THEN 'anchor_differs' END, CASE WHEN n <> nq THEN 'evidence_length_differs' END] IF x IS NOT NULL]) AS rule FROM v)""")
def unit_violations(spark: SparkSession, d: str) -> DataFrame:
    found = quality.unit_violations(table(spark, d, "all_units"), q.latest(table(spark, d, "qa")), placed_of(spark, d))
    return found.select("row_key", "rule")


_A = "annotation_rows AS (SELECT DISTINCT * EXCLUDE (evidence_turn_quotes, critical_event_ids, evidence_turn_ids) FROM annotation WHERE conversation_id IS NOT NULL AND dia_id IS NOT NULL)"


@query(W_T + f""", {_A}, c AS (SELECT conversation_id, count(DISTINCT session) AS total FROM turns GROUP BY ALL),
a AS (SELECT x.*, {_number("x.dia_id", 1)} AS s, {_number("x.dia_id", 2)} AS n FROM annotation_rows x),
j AS (SELECT a.*, t.text, coalesce(c.total, 0) AS total FROM a LEFT JOIN turns t ON a.conversation_id = t.conversation_id AND a.s = t.session AND a.n = t.turn LEFT JOIN c ON a.conversation_id = c.conversation_id)
SELECT conversation_id, dia_id, speaker, underlying_emotion, round(CASE {_level("memory_dependency_level", "'Level 0'")} WHEN 'Level 3' THEN 6 WHEN 'Level 2' THEN 4 WHEN 'Level 1' THEN 1.5 ELSE 0 END
  + CASE WHEN reasoning_structure IN ('trajectory-based', 'conflict-resolution') THEN 2 WHEN reasoning_structure = 'multi-hop' THEN 1.5 WHEN reasoning_structure = 'single-hop' THEN 0.5 ELSE 0 END
  + CASE lower(coalesce(implicit_explicit, '')) WHEN 'implicit' THEN 1 WHEN 'explicit' THEN -0.5 ELSE 0 END + CASE WHEN relation_state IN ('mild_strain', 'strained', 'fragile') THEN 1 ELSE 0 END
  + CASE WHEN s > 0 AND total > 0 THEN CASE WHEN s = total THEN -1.5 WHEN s = total - 1 THEN -0.5 WHEN s <= 2 THEN 1 ELSE 0 END ELSE 0 END
  - CASE WHEN {_any("text", rules.LATE_SUMMARY)} THEN 5 + CASE WHEN s = total THEN 2 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS score FROM j""")
def annotation_scores(spark: SparkSession, d: str) -> DataFrame:
    placed = placed_of(spark, d)
    rows = table(spark, d, "annotation").where("conversation_id is not null and dia_id is not null").drop("evidence_turn_quotes", "critical_event_ids", "evidence_turn_ids").distinct()
    totals = placed.groupBy("conversation_id").agg(F.countDistinct("session").alias("total_sessions"))
    return q.annotation_scores(rows, placed, totals).select("conversation_id", "dia_id", "speaker", "underlying_emotion", F.round("score", 6).alias("score"))


@query(W_Q + "SELECT question_type, memory_level, reasoning_structure, modality_condition, count(*) AS n, round(avg(len(evidence_turn_ids)), 6) AS mean_evidence FROM questions GROUP BY ALL")
def question_profile(spark: SparkSession, d: str) -> DataFrame:
    return questions_of(spark, d).groupBy("question_type", "memory_level", "reasoning_structure", "modality_condition").agg(
        F.count("*").alias("n"), F.round(F.avg(F.size("evidence_turn_ids")), 6).alias("mean_evidence")
    )


_KEY = r"lower(trim(regexp_replace(regexp_replace(CASE WHEN starts_with(b, '{') THEN coalesce(CASE WHEN json_valid(b) THEN json_extract_string(b, '$.answer') END, b) ELSE b END, '^[A-Z][).:\-]\s*', ''), '[\s\p{Z}]+', ' ', 'g')))"


@query(rf"SELECT qa_key, {_KEY} AS answer_key, length({_KEY}) AS n_chars FROM (SELECT qa_key, trim(regexp_replace(trim(regexp_replace({_strip('gold_answer')}, '^```(?:json)?', '', 'i')), '```$', '')) AS b FROM qa WHERE gold_answer IS NOT NULL)")
def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa").where("gold_answer is not null")
    return rows.select("qa_key", text.answer_key(F.col("gold_answer")).alias("answer_key")).withColumn("n_chars", F.length("answer_key").cast("bigint"))


@query("SELECT qa_key, array_to_string([chr(64 + CAST(i AS INTEGER)) || '. ' || coalesce(answer_options[i], 'None') FOR i IN range(1, len(answer_options) + 1)], chr(10)) AS options FROM qa WHERE len(answer_options) > 0")
def options_rendered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa").where("size(answer_options) > 0")
    return rows.select("qa_key", text.options_block(F.col("answer_options")).alias("options"))


# ---- retrieval ---------------------------------------------------------------------------------


def _searched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns, and queries with the place of their anchor; both are read several times and written once."""
    placed = checkpoint(placed_of(spark, d).drop("modality_available", "audio_id", "spoken_at"))
    base = q.anchored(questions_of(spark, d), placed).where("anchor_id is not null")
    spoken = F.concat_ws(" ", "question_text", "anchor_text", F.array_join("answer_options", " "))
    asked = checkpoint(base.select(F.col("qa_key").alias("query_id"), "conversation_id", "session", F.col("anchor_session_pos").alias("upto"), spoken.alias("text")))
    return placed.select("conversation_id", "session", F.col("session_pos").alias("pos"), "turn", F.concat_ws(" ", "speaker", "text", "voice_style").alias("text")), asked


def _all_scores(turns: DataFrame, asked: DataFrame, found: DataFrame, score: str) -> DataFrame:
    """The score of every turn of a query's session up to its place, 0 where nothing is shared."""
    every = asked.select("query_id", "conversation_id", "session", "upto").join(turns.drop("text"), ["conversation_id", "session"]).where("pos <= upto")
    return every.join(found.select("query_id", "pos", score), ["query_id", "pos"], "left").select(F.col("query_id").alias("qa_key"), "turn", F.round(F.coalesce(score, F.lit(0.0)), 6).alias(score))


_LOCAL = W_Q + r""", asked AS (SELECT qa_key, lower(concat_ws(' ', question_text, anchor_text, array_to_string(answer_options, ' '))) AS text FROM anchored WHERE anchor_id IS NOT NULL),
docs AS (SELECT a.qa_key, t.turn AS doc, lower(concat_ws(' ', t.speaker, t.text, t.voice_style)) AS text FROM anchored a JOIN turns t ON a.conversation_id = t.conversation_id AND a.session = t.session AND t.turn <= a.turn WHERE a.anchor_id IS NOT NULL),
qt AS (SELECT qa_key, term, count(*) AS qtf FROM (SELECT qa_key, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS term FROM asked) GROUP BY ALL),
dt AS (SELECT qa_key, doc, term, count(*) AS tf FROM (SELECT qa_key, doc, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS term FROM docs) GROUP BY ALL),
dl AS (SELECT qa_key, doc, len(regexp_extract_all(text, '[a-z0-9]+')) AS len FROM docs),
st AS (SELECT qa_key, count(*) AS n_docs, avg(len) AS avg_len FROM dl GROUP BY ALL), dfs AS (SELECT qa_key, term, count(*) AS df FROM dt GROUP BY ALL),
bm AS (SELECT qa_key, doc, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / greatest(tf + 1.2 * (0.25 + 0.75 * len / greatest(avg_len, 1.0)), 1e-9)) AS bm25
       FROM qt JOIN dfs USING (qa_key, term) JOIN st USING (qa_key) JOIN dt USING (qa_key, term) JOIN dl USING (qa_key, doc) GROUP BY ALL),
sq AS (SELECT qa_key, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS s FROM asked), sd AS (SELECT qa_key, doc, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS s FROM docs),
gq AS (SELECT qa_key, g, count(*) AS n FROM (SELECT qa_key, unnest([s[i:i+2] FOR i IN range(1, length(s) - 1)]) AS g FROM sq) GROUP BY ALL),
gd AS (SELECT qa_key, doc, g, count(*) AS n FROM (SELECT qa_key, doc, unnest([s[i:i+2] FOR i IN range(1, length(s) - 1)]) AS g FROM sd) GROUP BY ALL),
nq AS (SELECT qa_key, sqrt(sum(n * n)) AS v FROM gq GROUP BY ALL), nd AS (SELECT qa_key, doc, sqrt(sum(n * n)) AS v FROM gd GROUP BY ALL),
co AS (SELECT qa_key, doc, sum(gq.n * gd.n) AS dot FROM gq JOIN gd USING (qa_key, g) GROUP BY ALL),
ranked AS (SELECT d.qa_key, d.doc, coalesce(bm25, 0) AS bm25, coalesce(dot / (nq.v * nd.v), 0) AS cosine FROM docs d LEFT JOIN bm USING (qa_key, doc) LEFT JOIN co USING (qa_key, doc) LEFT JOIN nq USING (qa_key) LEFT JOIN nd USING (qa_key, doc)),
lim AS (SELECT *, min(bm25) OVER w AS bl, max(bm25) OVER w AS bh, min(cosine) OVER w AS cl, max(cosine) OVER w AS ch FROM ranked WINDOW w AS (PARTITION BY qa_key)),
hyb AS (SELECT qa_key, doc, bm25, cosine, 0.5 * CASE WHEN bh - bl < 1e-9 THEN CASE WHEN bh <= 0 THEN 0 ELSE 1 END ELSE (bm25 - bl) / (bh - bl) END + 0.5 * CASE WHEN ch - cl < 1e-9 THEN CASE WHEN ch <= 0 THEN 0 ELSE 1 END ELSE (cosine - cl) / (ch - cl) END AS score FROM lim)
"""


@query(_LOCAL + "SELECT qa_key, doc AS turn, round(bm25, 6) AS bm25 FROM ranked")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    turns, asked = _searched(spark, d)
    return _all_scores(turns, asked, retrieval.bm25_upto(asked, turns), "bm25")


@query(_LOCAL + "SELECT qa_key, doc AS turn, round(cosine, 6) AS cosine FROM ranked")
def trigram_cosine(spark: SparkSession, d: str) -> DataFrame:
    turns, asked = _searched(spark, d)
    return _all_scores(turns, asked, retrieval.cosine_upto(asked, turns), "cosine")


@query(_LOCAL + "SELECT qa_key, doc AS turn, rank, round(round(score, 9), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qa_key ORDER BY round(score, 9) DESC, doc) AS rank FROM hyb) WHERE rank <= 4")
def hybrid_top(spark: SparkSession, d: str) -> DataFrame:
    best = retrieval.local_top(turns_of(spark, d), _packable(questions_of(spark, d)))
    return best.select(F.col("query_id").alias("qa_key"), "turn", "rank", F.round("score", 6).alias("score"))


def _packable(questions: DataFrame) -> DataFrame:
    """Questions with the session and turn that their anchor names, as the packed searches read them."""
    n = turn_numbers(F.col("anchor_dia_id"))
    return questions.select(F.col("qa_key").alias("query_id"), "conversation_id", n["session"].alias("session"), n["turn"].alias("turn"), "question_text", F.array_join("answer_options", " ").alias("options"))


def _ranked(prefix: str, asked: str, docs: str) -> str:
    """SQL of the hybrid score (table ``<prefix>hyb``: qa_key, doc, score) of documents for the query of their key."""
    p = prefix
    return rf"""{p}qt AS (SELECT qa_key, term, count(*) AS qtf FROM (SELECT qa_key, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS term FROM {asked}) GROUP BY ALL),
{p}dt AS (SELECT qa_key, doc, term, count(*) AS tf FROM (SELECT qa_key, doc, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS term FROM {docs}) GROUP BY ALL),
{p}dl AS (SELECT qa_key, doc, len(regexp_extract_all(text, '[a-z0-9]+')) AS len FROM {docs}),
{p}st AS (SELECT qa_key, count(*) AS n_docs, avg(len) AS avg_len FROM {p}dl GROUP BY ALL), {p}dfs AS (SELECT qa_key, term, count(*) AS df FROM {p}dt GROUP BY ALL),
{p}bm AS (SELECT qa_key, doc, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / greatest(tf + 1.2 * (0.25 + 0.75 * len / greatest(avg_len, 1.0)), 1e-9)) AS bm25
  FROM {p}qt JOIN {p}dfs USING (qa_key, term) JOIN {p}st USING (qa_key) JOIN {p}dt USING (qa_key, term) JOIN {p}dl USING (qa_key, doc) GROUP BY ALL),
{p}sq AS (SELECT qa_key, trim(regexp_replace(text, '[\s\p{{Z}}]+', ' ', 'g')) AS s FROM {asked}), {p}sd AS (SELECT qa_key, doc, trim(regexp_replace(text, '[\s\p{{Z}}]+', ' ', 'g')) AS s FROM {docs}),
{p}gq AS (SELECT qa_key, g, count(*) AS n FROM (SELECT qa_key, unnest([s[i:i+2] FOR i IN range(1, greatest(length(s) - 1, 2))]) AS g FROM {p}sq WHERE s <> '') GROUP BY ALL),
{p}gd AS (SELECT qa_key, doc, g, count(*) AS n FROM (SELECT qa_key, doc, unnest([s[i:i+2] FOR i IN range(1, greatest(length(s) - 1, 2))]) AS g FROM {p}sd WHERE s <> '') GROUP BY ALL),
{p}nq AS (SELECT qa_key, sqrt(sum(n * n)) AS v FROM {p}gq GROUP BY ALL), {p}nd AS (SELECT qa_key, doc, sqrt(sum(n * n)) AS v FROM {p}gd GROUP BY ALL),
{p}co AS (SELECT qa_key, doc, sum(q.n * d.n) AS dot FROM {p}gq q JOIN {p}gd d USING (qa_key, g) GROUP BY ALL),
{p}ranked AS (SELECT d.qa_key, d.doc, coalesce(bm25, 0) AS bm25, coalesce(dot / (q.v * n.v), 0) AS cosine FROM {docs} d LEFT JOIN {p}bm USING (qa_key, doc) LEFT JOIN {p}co USING (qa_key, doc) LEFT JOIN {p}nq q USING (qa_key) LEFT JOIN {p}nd n USING (qa_key, doc)),
{p}lim AS (SELECT *, min(bm25) OVER w AS bl, max(bm25) OVER w AS bh, min(cosine) OVER w AS cl, max(cosine) OVER w AS ch FROM {p}ranked WINDOW w AS (PARTITION BY qa_key)),
{p}hyb AS (SELECT qa_key, doc, round(0.5 * CASE WHEN bh - bl < 1e-9 THEN CASE WHEN bh <= 0 THEN 0 ELSE 1 END ELSE (bm25 - bl) / (bh - bl) END + 0.5 * CASE WHEN ch - cl < 1e-9 THEN CASE WHEN ch <= 0 THEN 0 ELSE 1 END ELSE (cosine - cl) / (ch - cl) END, 9) AS score FROM {p}lim)"""


_FIRST = W_Q + r""", asked AS (SELECT qa_key, lower(concat_ws(' ', question_text, anchor_text, array_to_string(answer_options, ' '))) AS text FROM anchored WHERE anchor_id IS NOT NULL),
hist AS (SELECT a.qa_key, t.session, t.history_pos AS pos, t.dia_id, lower(concat_ws(' ', t.speaker, t.text, t.voice_style)) AS line FROM anchored a JOIN turns t ON a.conversation_id = t.conversation_id AND t.history_pos <= a.anchor_pos WHERE a.anchor_id IS NOT NULL),
sdocs AS (SELECT qa_key, session AS doc, string_agg(line, chr(10) ORDER BY pos) AS text FROM hist GROUP BY ALL), """ + _ranked("s", "asked", "sdocs") + r""",
best AS (SELECT qa_key, doc AS session FROM (SELECT *, row_number() OVER (PARTITION BY qa_key ORDER BY score DESC, doc) AS r FROM shyb) WHERE r <= 2),
mem AS (SELECT c.qa_key, c.pos AS win, m.pos, m.session, m.dia_id, m.line FROM hist c JOIN hist m ON c.qa_key = m.qa_key AND m.pos BETWEEN c.pos - 2 AND c.pos + 2),
wins AS (SELECT qa_key, win, arg_min(session, pos) AS session, string_agg(line, chr(10) ORDER BY pos) AS text FROM mem GROUP BY ALL),
flag AS (SELECT w.*, b.session IS NOT NULL AS kept, bool_or(b.session IS NOT NULL) OVER (PARTITION BY w.qa_key) AS any_kept FROM wins w LEFT JOIN best b ON w.qa_key = b.qa_key AND w.session = b.session),
wdocs AS (SELECT qa_key, win AS doc, text FROM flag WHERE kept OR NOT any_kept), """ + _ranked("w", "asked", "wdocs") + r""",
top AS (SELECT qa_key, doc AS win FROM (SELECT *, row_number() OVER (PARTITION BY qa_key ORDER BY score DESC, doc) AS r FROM whyb) WHERE r <= 4)
SELECT DISTINCT m.qa_key, m.pos, m.dia_id FROM top t JOIN mem m ON t.qa_key = m.qa_key AND t.win = m.win"""


@query(_FIRST)
def session_first_context(spark: SparkSession, d: str) -> DataFrame:
    """Two-level selection over the whole history up to the anchor of every question."""
    asked = checkpoint(_packable(questions_of(spark, d)).where("session is not null"))  # read twice
    return retrieval.session_first(turns_of(spark, d), asked).withColumnRenamed("query_id", "qa_key")


# ---- evaluation analytics ------------------------------------------------------------------------


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events as an evaluation log: event types are runs, users items, values scores."""
    return table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("user_id").alias("item"), "value", "event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


_ITEMS = "r AS (SELECT event_type AS run, user_id AS item, round(avg(value), 6) AS score FROM events GROUP BY ALL)"


@query("SELECT coalesce(nullif(event_type, ''), 'unknown') AS \"group\", count(*) AS count, CAST(round(CAST(avg(value) AS DECIMAL(28, 9)), 3) AS DOUBLE) AS mean FROM events GROUP BY ALL")
def group_mean_scores(spark: SparkSession, d: str) -> DataFrame:
    return analytics.group_mean(_runs(spark, d), "run", "value")


@query("SELECT 'overall' AS dimension, 'all' AS \"group\", count(*) AS count, CAST(round(CAST(avg(value) AS DECIMAL(28, 9)), 3) AS DOUBLE) AS mean FROM events UNION ALL SELECT 'run', coalesce(nullif(event_type, ''), 'unknown'), count(*), CAST(round(CAST(avg(value) AS DECIMAL(28, 9)), 3) AS DOUBLE) FROM events GROUP BY ALL UNION ALL SELECT 'decade', CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS VARCHAR), count(*), CAST(round(CAST(avg(value) AS DECIMAL(28, 9)), 3) AS DOUBLE) FROM events GROUP BY ALL")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _runs(spark, d).withColumn("decade", F.floor(F.col("k") / 10).cast("string"))
    return analytics.summary(rows, ["run", "decade"], "value")


@query(f"WITH {_ITEMS}, n AS (SELECT count(DISTINCT run) AS n FROM r) SELECT item, round(min(score), 3) AS min_score, round(max(score), 3) AS max_score, round(avg(score), 3) AS mean_score, count(*) FILTER (WHERE score >= 20) = any_value(n.n) AS all_above, any_value(n.n) - count(score) AS n_missing FROM r, n GROUP BY item HAVING count(score) > 0")
def cross_run_scores(spark: SparkSession, d: str) -> DataFrame:
    per_item = _runs(spark, d).groupBy("run", "item").agg(F.round(F.avg("value"), 6).alias("score"))
    return analytics.cross_run(per_item, 20.0)


@query(f"WITH {_ITEMS}, p AS (SELECT item, max(score) FILTER (WHERE run = 'click') AS click, max(score) FILTER (WHERE run = 'view') AS view, max(score) FILTER (WHERE run = 'purchase') AS purchase, max(score) FILTER (WHERE run = 'signup') AS signup, max(score) FILTER (WHERE run = 'error') AS error FROM r GROUP BY ALL) SELECT item, click, view, purchase, signup, error, CASE WHEN item % 2 = 0 THEN click ELSE view END AS effective FROM p")
def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    per = _runs(spark, d).groupBy("run", "item").agg(F.round(F.avg("value"), 6).alias("score"))
    wide = per.groupBy("item").pivot("run", ["click", "view", "purchase", "signup", "error"]).agg(F.max("score"))
    return wide.withColumn("effective", analytics.effective(F.col("item") % 2 == 0, F.col("click"), F.col("view")))


@query("SELECT d.doc_id, l.score FROM documents d LEFT JOIN (SELECT doc_id, round(avg(is_abusive), 6) AS score FROM review_labels GROUP BY ALL) l USING (doc_id) ORDER BY coalesce(l.score, 999), CAST(d.doc_id AS VARCHAR) LIMIT 5")
def bottom_items(spark: SparkSession, d: str) -> DataFrame:
    """Top-k report: the five lowest scored documents, unscored ones last."""
    scores = table(spark, d, "review_labels").groupBy("doc_id").agg(F.round(F.avg("is_abusive"), 6).alias("score"))
    rows = table(spark, d, "documents").select("doc_id").join(scores, "doc_id", "left").withColumn("__key", F.col("doc_id").cast("string"))
    return analytics.bottom(rows, "score", "__key").drop("__key")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM review_labels WHERE is_abusive IS NOT NULL) OR doc_id IN (SELECT doc_id FROM review_labels WHERE is_abusive IS NULL)")
def retry_documents(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "review_labels")
    return analytics.retry(table(spark, d, "documents").select("doc_id", "source"), labels.where("is_abusive is not null"), labels.where("is_abusive is null"), "doc_id")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 3 THEN 'parse_error' WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS verdict,
  round(CASE WHEN event_id % 7 = 3 THEN 0 ELSE 0.35 * v + 0.30 * ((event_id % 10) / 10) + 0.20 * CASE WHEN event_id % 3 = 0 THEN 0 ELSE 0.5 END + 0.10 * 1.0 + 0.05 * v END, 6) AS weighted
  FROM (SELECT *, round(value, 2) / 1000 AS v FROM events)""")
def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a judge, fenced, incomplete or broken, as partial scores, verdict and weighted score."""
    v, n = F.round("value", 2) / 1000, F.col("event_id")
    said = F.concat(
        F.when(n % 2 == 0, "```json\n").otherwise(" "), F.lit('{"core_answer_correct": '), v.cast("string"), F.lit(', "key_point_coverage": "'), (n % 10 / 10).cast("string"),
        F.lit('", "rationale_alignment": '), F.when(n % 3 == 0, '"none"').otherwise("0.5"), F.lit(', "unsupported_claims": 1, "insufficiency_handling": '), v.cast("string"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(', "verdict": "'), "event_type", F.lit('"'))), F.when(n % 7 == 3, ", ").otherwise("}"), F.when(n % 2 == 0, "\n```").otherwise(""),
    )
    parsed = table(spark, d, "events").select("event_id", text.judge_scores(said).alias("s"))
    return parsed.select("event_id", "s.verdict", F.round(analytics.weighted_judgement(F.col("s")), 6).alias("weighted"))


@query("SELECT conversation_id, session_count, i AS session_no, session_count // 3 + CASE WHEN i <= session_count % 3 THEN 1 ELSE 0 END AS share, session_count + greatest(2, CAST(ceil(session_count * 0.25) AS BIGINT)) AS asked_for, CASE WHEN session_count >= 16 THEN 3 WHEN session_count >= 10 THEN 2 ELSE 1 END AS n_events FROM (SELECT DISTINCT conversation_id, session_count FROM conversation_head WHERE session_count IS NOT NULL), (SELECT unnest([1, 2, 3]) AS i)")
def quota_shares(spark: SparkSession, d: str) -> DataFrame:
    """Sessions dealt over three stages, oversampled counts and events per size."""
    heads = table(spark, d, "conversation_head").where("session_count is not null").select("conversation_id", "session_count").distinct()
    n = F.col("session_count")
    return heads.withColumn("session_no", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        "conversation_id", "session_count", "session_no", planning.even_share(n, F.lit(3), F.col("session_no")).cast("int").alias("share"),
        planning.oversampled(n).alias("asked_for"), planning.event_count(n).alias("n_events"),
    )
