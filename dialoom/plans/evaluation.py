"""Queries over evaluation runs and dataset items, each with the SQL it must equal.

The events serve as a log of runs: users are items and traces, the type of an event says what it is.
Exported units are the dataset items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import analytics, items, runs
from dialoom.plans.reference import W_Q, W_T, _strip, placed_of, questions_of
from dialoom.operators import questions as q
from dialoom.operators import units as u
from dialoom.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- runs -------------------------------------------------------------------------------------


def _observations(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    said = F.when(n % 4 == 0, F.concat(F.lit('{"content": "said '), k, F.lit('"}'))).when(n % 4 == 1, F.concat(F.lit("plain "), k)).when(n % 4 == 2, F.lit('{"content": 5}'))
    return table(spark, d, "events").select(
        F.col("user_id").alias("trace"), F.when(F.col("event_type") == "click", "GENERATION").when(F.col("event_type") == "view", "SPAN").otherwise("EVENT").alias("kind"),
        F.round("value", 1).alias("latency"), n.alias("pos"), said.alias("output"), (n % 50).alias("prompt_tokens"), (n % 20).alias("completion_tokens"), n.alias("observation"),
    )


def _scores(spark: SparkSession, d: str) -> DataFrame:
    metric = F.when(F.col("event_type") == "purchase", "exact_match").when(F.col("event_type") == "signup", "llm_judge_final").when(F.col("event_type") == "error", "judge_key_point_coverage")
    value = F.when(F.col("event_id") % 11 == 0, "n/a").otherwise((F.round("value", 2) / 100).cast("string"))
    return table(spark, d, "events").select(F.col("user_id").alias("trace"), metric.alias("metric"), value.alias("value"), F.col("event_id").alias("pos"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    said = F.when(F.col("trace") % 5 == 0, '{"answer": "yes", "context_policy": "full_history"}').when(F.col("trace") % 5 == 1, '{"content": "no"}').when(F.col("trace") % 5 == 2, '{"answer": 1}')
    traces = events.select(F.col("user_id").alias("trace")).distinct().select("trace", said.alias("output"), F.concat(F.lit("t/"), "trace").alias("trace_url"))
    t = lambda key: items.task("task_layer", key)
    known = table(spark, d, "all_units").select(
        F.col("unit_key").alias("item"), runs.first_given(t("question_id"), F.col("question_id")).alias("question_id"), runs.first_given(t("question_type"), t("qtype")).alias("question_type"),
        runs.first_given(t("content_type"), t("content")).alias("content_type"), runs.level_of_digit(runs.first_given(t("memory_level"), t("memory"))).alias("memory_level"),
        runs.first_given(t("reasoning_structure"), t("reasoning")).alias("reasoning_structure"), runs.first_given(t("modality_condition"), t("modality")).alias("modality_condition"),
        F.coalesce(~t("options").isin("[]", "null"), F.lit(False)).alias("has_options"), t("gold_answer").alias("gold_answer"), t("question_text").alias("question_text"),
    )
    run_items = events.where("event_type <> 'view'").select(F.col("user_id").alias("item"), F.col("user_id").alias("trace")).distinct()
    return runs.run_rows(run_items, known, traces, _observations(spark, d), _scores(spark, d))


_LOG = r"""WITH obs AS (
  SELECT user_id AS trace, CASE event_type WHEN 'click' THEN 'GENERATION' WHEN 'view' THEN 'SPAN' ELSE 'EVENT' END AS kind, round(value, 1) AS latency, event_id AS pos,
         CASE event_id % 4 WHEN 0 THEN '{"content": "said ' || json_extract_string(props, '$.k') || '"}' WHEN 1 THEN 'plain ' || json_extract_string(props, '$.k') WHEN 2 THEN '{"content": 5}' END AS output,
         event_id % 50 AS prompt_tokens, event_id % 20 AS completion_tokens FROM events
), longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace, kind ORDER BY coalesce(latency, 0) DESC, pos) AS r FROM obs) WHERE r = 1)
"""


@query(_LOG + "SELECT trace, kind, latency, pos AS observation FROM longest WHERE kind <> 'EVENT'")
def longest_observations(spark: SparkSession, d: str) -> DataFrame:
    """Of each trace the generation and the span with the largest latency."""
    seen = _observations(spark, d)
    parts = [runs.longest(seen, kind, "latency", "observation").withColumn("kind", F.lit(kind)) for kind in ("GENERATION", "SPAN")]
    return parts[0].unionByName(parts[1]).select("trace", "kind", "latency", "observation")


_TASK = "CASE WHEN starts_with(ltrim(task_layer), '{') AND json_valid(task_layer) THEN json(task_layer) END"
_RUN = _LOG + f""", scored AS (
  SELECT user_id AS trace, CASE event_type WHEN 'purchase' THEN 'exact_match' WHEN 'signup' THEN 'llm_judge_final' ELSE 'judge_key_point_coverage' END AS metric, round(value, 2) / 100 AS score, event_id
  FROM events WHERE event_type IN ('purchase', 'signup', 'error') AND event_id % 11 <> 0
), last AS (SELECT trace, metric, arg_max(score, event_id) AS score FROM scored GROUP BY ALL
), wide AS (SELECT trace, max(score) FILTER (WHERE metric = 'exact_match') AS exact_match, max(score) FILTER (WHERE metric = 'llm_judge_final') AS llm_judge_final, max(score) FILTER (WHERE metric = 'judge_key_point_coverage') AS coverage FROM last GROUP BY ALL
), known AS (
  SELECT unit_key AS item, coalesce(nullif(t ->> '$.question_id', ''), nullif(question_id, '')) AS question_id, coalesce(nullif(t ->> '$.question_type', ''), nullif(t ->> '$.qtype', '')) AS question_type,
         coalesce(nullif(t ->> '$.content_type', ''), nullif(t ->> '$.content', '')) AS content_type, coalesce(nullif(t ->> '$.memory_level', ''), nullif(t ->> '$.memory', '')) AS level,
         coalesce(nullif(t ->> '$.reasoning_structure', ''), nullif(t ->> '$.reasoning', '')) AS reasoning_structure, coalesce(nullif(t ->> '$.modality_condition', ''), nullif(t ->> '$.modality', '')) AS modality_condition,
         coalesce((t ->> '$.options') NOT IN ('[]', 'null'), false) AS has_options, t ->> '$.gold_answer' AS gold_answer, t ->> '$.question_text' AS question_text
  FROM (SELECT *, {_TASK} AS t FROM all_units)
), run AS (
  SELECT k.item, k.item AS trace, question_id, question_type, content_type, CASE WHEN regexp_matches(level, '^[0-9]+$') THEN 'Level ' || level ELSE level END AS memory_level, reasoning_structure, modality_condition, has_options,
         CASE WHEN k.item % 5 = 0 THEN 'full_history' ELSE 'unknown' END AS context_policy, CASE WHEN has_options THEN exact_match ELSE llm_judge_final END AS effective_score, exact_match, llm_judge_final, coverage,
         g.prompt_tokens, g.completion_tokens, g.prompt_tokens + g.completion_tokens AS total_tokens, g.latency AS generation_latency_seconds,
         CASE WHEN k.item % 5 = 0 THEN 'yes' WHEN k.item % 5 = 1 THEN 'no' WHEN g.pos % 4 = 0 THEN g.output ->> '$.content' WHEN g.pos % 4 = 1 THEN g.output ELSE '' END AS model_output, gold_answer, question_text, 't/' || k.item AS trace_url
  FROM known k LEFT JOIN longest g ON g.trace = k.item AND g.kind = 'GENERATION' LEFT JOIN wide w ON w.trace = k.item
  WHERE k.item IN (SELECT user_id FROM events WHERE event_type <> 'view')
)
"""


@query(_RUN + "SELECT * EXCLUDE (coverage), NULL::DOUBLE AS judge_core_answer_correct, coverage AS judge_key_point_coverage, NULL::DOUBLE AS judge_rationale_alignment, NULL::DOUBLE AS judge_unsupported_claims, NULL::DOUBLE AS judge_insufficiency_handling FROM run")
def run_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).drop("scores")


@query(_RUN + """SELECT metric, CAST(round(CAST(avg(v) AS DECIMAL(28, 9)), 3) AS DOUBLE) AS mean, count(v) AS n FROM (SELECT 'exact_match' AS metric, exact_match AS v FROM run UNION ALL SELECT 'llm_judge_final', llm_judge_final FROM run
  UNION ALL SELECT 'judge_key_point_coverage', coverage FROM run UNION ALL SELECT 'effective_score', effective_score FROM run) GROUP BY ALL HAVING count(v) > 0 OR metric = 'effective_score'""")
def run_metric_means(spark: SparkSession, d: str) -> DataFrame:
    return runs.metric_means(_rows(spark, d))


@query(_RUN + """, g AS (SELECT 'overall' AS dimension, 'all' AS grp, effective_score AS v FROM run UNION ALL SELECT 'question_type', coalesce(nullif(question_type, ''), 'unknown'), effective_score FROM run
  UNION ALL SELECT 'memory_level', coalesce(nullif(memory_level, ''), 'unknown'), effective_score FROM run UNION ALL SELECT 'content_type', coalesce(nullif(content_type, ''), 'unknown'), effective_score FROM run)
SELECT dimension, grp AS "group", count(*) AS count, CAST(round(CAST(avg(v) AS DECIMAL(28, 9)), 3) AS DOUBLE) AS mean FROM g GROUP BY ALL""")
def run_group_means(spark: SparkSession, d: str) -> DataFrame:
    return runs.grouped_means(_rows(spark, d), ["question_type", "memory_level", "content_type"])


_SHORTENED = r"CASE WHEN length({x}) > 240 THEN left({x}, 237) || '...' ELSE {x} END"


def _short(c: str) -> str:
    return _SHORTENED.format(x=rf"trim(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}]+', ' ', 'g'))")


@query(_RUN + f"SELECT item, question_id, question_type, effective_score, {_short('model_output')} AS model_output, {_short('gold_answer')} AS gold_answer, {_short('question_text')} AS question_text FROM run ORDER BY coalesce(effective_score, 999), coalesce(question_id, ''), item LIMIT 5")
def run_lowest(spark: SparkSession, d: str) -> DataFrame:
    """Top-k report: the five items of the lowest effective score."""
    return runs.lowest(_rows(spark, d), "effective_score")


@query(_RUN + f"SELECT item, question_id, question_type, llm_judge_final, {_short('model_output')} AS model_output, {_short('gold_answer')} AS gold_answer, {_short('question_text')} AS question_text FROM run WHERE NOT has_options ORDER BY coalesce(llm_judge_final, 999), coalesce(question_id, ''), item LIMIT 5")
def run_lowest_open(spark: SparkSession, d: str) -> DataFrame:
    """Top-k report: the five open questions the judge scored lowest."""
    return runs.lowest(_rows(spark, d).where("not has_options"), "llm_judge_final")


_BY_RUN = "WITH r AS (SELECT event_type AS run, user_id AS item, round(avg(value), 6) AS score FROM events WHERE user_id % 7 <> 3 OR event_type <> 'click' GROUP BY ALL)"


def _by_run(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "events").where("user_id % 7 <> 3 or event_type <> 'click'")
    return kept.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("item")).agg(F.round(F.avg("value"), 6).alias("score"))


@query(_BY_RUN + " SELECT i.item, n.run, r.score FROM (SELECT DISTINCT item FROM r) i JOIN (SELECT DISTINCT run FROM r) n ON true LEFT JOIN r ON r.item = i.item AND r.run = n.run")
def runs_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Every item in every run, with null where a run lacks it."""
    return runs.aligned(_by_run(spark, d))


@query(_BY_RUN + """, n AS (SELECT count(DISTINCT run) AS n FROM r), c AS (SELECT item, round(avg(score), 3) AS mean_score, count(*) FILTER (WHERE score >= 24) = any_value(n.n) AS all_above FROM r, n GROUP BY item)
SELECT count(*) FILTER (WHERE all_above) AS n_easy, round(100.0 * count(*) FILTER (WHERE all_above) / count(*), 1) AS easy_pct FROM c""")
def easy_share(spark: SparkSession, d: str) -> DataFrame:
    """Number and share of the items that every run got right."""
    scores = _by_run(spark, d)
    return analytics.share_above(analytics.cross_run(scores, 24.0), F.count("*"))


@query(_BY_RUN + """, n AS (SELECT count(DISTINCT run) AS n FROM r), c AS (SELECT item, round(avg(score), 3) AS mean_score, count(*) FILTER (WHERE score >= 24) = any_value(n.n) AS all_above FROM r, n GROUP BY item)
SELECT item, mean_score, row_number() OVER (ORDER BY mean_score DESC, item) AS rank FROM c WHERE NOT all_above ORDER BY rank LIMIT 20""")
def partly_right_items(spark: SparkSession, d: str) -> DataFrame:
    """Top-k report: the twenty best items that not every run got right."""
    partly = analytics.cross_run(_by_run(spark, d), 24.0).where("not all_above")
    return runs.ranked_by_mean(partly, 20).select("item", "mean_score", "rank")


# ---- items ------------------------------------------------------------------------------------

_SLUG = r"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_CONV, _NAMED = "coalesce(nullif(conversation_id, ''), 'conversation')", "coalesce(nullif(question_id, ''), nullif(unit_id, ''), 'item')"
_ITEM = f"'demo-set__' || {_SLUG.format(x=_CONV)} || '__' || {_SLUG.format(x=_NAMED)} || '__' || left(sha1(coalesce(unit_id, '') || '||' || coalesce(conversation_id, '') || '||' || coalesce(question_id, '') || '||' || coalesce(anchor.dia_id, '') || '||' || coalesce(anchor.text, '') || '||' || coalesce(t ->> '$.question_text', '')), 12)"
_ITEMS = f"WITH i AS (SELECT *, {_ITEM} AS item_id FROM (SELECT *, {_TASK} AS t FROM all_units))"


@query(_ITEMS + f""" SELECT item_id, question_id AS qid, unit_id, 'units::' || unit_key || '::' || {_CONV} || '::' || {_NAMED} || '::' || coalesce(nullif(anchor.dia_id, ''), 'no-anchor') AS source_marker,
  t ->> '$.question_type' AS qtype, CASE WHEN starts_with(t ->> '$.memory_level', 'Level ') THEN trim(replace(t ->> '$.memory_level', 'Level ', '')) ELSE coalesce(t ->> '$.memory_level', '') END AS memory,
  CASE m WHEN '' THEN 'normal' WHEN 'voice_style_missing' THEN 'missing' WHEN 'voice_style_removed' THEN 'missing' WHEN 'modality_missing' THEN 'missing' WHEN 'voice_style_ambiguous' THEN 'low_quality'
    WHEN 'modality_ambiguous' THEN 'low_quality' WHEN 'text_ambiguous' THEN 'low_quality' WHEN 'text_removed' THEN 'missing' ELSE m END AS modality,
  anchor.spoken_at AS anchor_time, len(history_evidence) AS n_evidence FROM (SELECT *, lower(trim(coalesce(t ->> '$.modality_condition', 'normal'))) AS m FROM i)""")
def dataset_items(spark: SparkSession, d: str) -> DataFrame:
    built = items.dataset_items(table(spark, d, "all_units"), "demo set", "units", F.col("unit_key"))
    return built.select("item_id", "metadata.qid", "metadata.unit_id", "metadata.source_marker", "metadata.qtype", "metadata.memory", "metadata.modality",
                        F.col("input.anchor.timestamp").alias("anchor_time"), F.when(F.col("input.benchmark_views.gold_evidence_context").isNotNull(), F.size("input.benchmark_views.gold_evidence_context")).cast("bigint").alias("n_evidence"))


@query(_ITEMS + f" SELECT item_id, count(*) AS n, string_agg('x::' || unit_key || '::' || {_CONV} || '::' || {_NAMED} || '::' || coalesce(nullif(anchor.dia_id, ''), 'no-anchor'), ' ' ORDER BY unit_key) AS markers FROM i GROUP BY item_id HAVING count(*) > 1")
def item_ids_taken_twice(spark: SparkSession, d: str) -> DataFrame:
    """Item ids that stand for several units, with where each comes from."""
    marked = table(spark, d, "all_units").select("unit_key", items.item_id("demo set").alias("item_id"), items.source_marker("x", F.col("unit_key")).alias("marker"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_key", "marker"))), lambda x: x["marker"]), " ")
    return marked.groupBy("item_id").agg(F.count("*").alias("n"), listed.alias("markers")).where("n > 1")


@query(_ITEMS + ", old AS (SELECT item_id, min(unit_key) AS unit_key FROM i WHERE unit_key % 3 = 0 GROUP BY ALL), new AS (SELECT item_id, min(unit_key) AS unit_key FROM i WHERE unit_key % 3 <> 0 GROUP BY ALL) SELECT item_id, true AS fresh FROM new UNION ALL SELECT item_id, false FROM old WHERE item_id NOT IN (SELECT item_id FROM new)")
def dataset_upserted(spark: SparkSession, d: str) -> DataFrame:
    """A dataset of every third unit, with the others put in."""
    every = table(spark, d, "all_units").select("unit_key", items.item_id("demo set").alias("item_id"))
    old, new = every.where("unit_key % 3 = 0").dropDuplicates(["item_id"]), every.where("unit_key % 3 <> 0")
    return items.upserted(old.select("item_id", F.lit(False).alias("fresh")), new.select("item_id", F.lit(True).alias("fresh")))




def _key_of(x: str) -> str:
    bare = f"trim(regexp_replace(trim(regexp_replace({_strip(x)}, '^```(?:json)?', '', 'i')), '```$', ''))"
    inner = f"CASE WHEN starts_with({bare}, '{{') AND json_valid({bare}) THEN coalesce(json_extract_string({bare}, '$.answer'), {bare}) ELSE {bare} END"
    return rf"lower(trim(regexp_replace(regexp_replace({inner}, '^[A-Z][).:\-]\s*', ''), '[\s\p{{Z}}]+', ' ', 'g')))"


@query(rf"""WITH p AS (SELECT *, CASE WHEN qa_key % 2 = 0 THEN 'B) ' || coalesce(gold_answer, 'x') WHEN len(acceptable_answers) > 0 THEN upper(acceptable_answers[1]) ELSE answer_options[1] END AS said FROM qa),
k AS (SELECT qa_key, answer_options, {_key_of("coalesce(said, '')")} AS said_key, [gold_answer, *coalesce(acceptable_answers, [])] AS named FROM p),
n AS (SELECT qa_key, {_key_of("x")} AS key FROM (SELECT qa_key, unnest(named) AS x FROM k) WHERE trim(x) <> '')
SELECT qa_key, CASE WHEN len(answer_options) > 0 THEN CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.qa_key = k.qa_key AND n.key = k.said_key) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS exact_match FROM k""".replace("[gold_answer, *coalesce(acceptable_answers, [])]", "list_concat([gold_answer], coalesce(acceptable_answers, []))"))
def exact_matches(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("qa_key") % 2 == 0, F.concat(F.lit("B) "), F.coalesce("gold_answer", F.lit("x")))).when(F.size("acceptable_answers") > 0, F.upper(F.get("acceptable_answers", 0))).otherwise(F.get("answer_options", 0))
    return table(spark, d, "qa").select("qa_key", items.exact_match(said, F.col("gold_answer"), F.col("acceptable_answers"), F.col("answer_options")).alias("exact_match"))


_TURN = "'[' || coalesce(t.spoken_at, '') || '] ' || coalesce(nullif(t.speaker, ''), 'Unknown') || ': ' || coalesce(t.text, '') || CASE WHEN coalesce(t.voice_style, '') <> '' THEN chr(10) || 'voice_style: ' || t.voice_style ELSE '' END"


@query(W_Q + f""", l AS (SELECT a.qa_key, string_agg({_TURN}, chr(10) || chr(10) ORDER BY t.turn) AS body FROM anchored a JOIN turns t ON a.conversation_id = t.conversation_id AND a.session = t.session AND t.turn <= a.turn WHERE a.anchor_id IS NOT NULL GROUP BY ALL),
e AS (SELECT e.qa_key, string_agg({_TURN}, chr(10) || chr(10) ORDER BY e.pos) AS body FROM evidence e JOIN turns t ON e.conversation_id = t.conversation_id AND e.session = t.session AND e.turn = t.turn GROUP BY ALL)
SELECT l.qa_key, CASE WHEN l.qa_key % 3 = 0 THEN 'session_local' WHEN l.qa_key % 3 = 1 THEN 'gold_evidence' ELSE 'session_local_plus_gold_evidence' END AS policy,
  md5(CASE WHEN l.qa_key % 3 = 0 THEN l.body WHEN l.qa_key % 3 = 1 THEN coalesce(e.body, '') WHEN coalesce(e.body, '') <> '' THEN '[Full Conversation History]' || chr(10) || l.body || chr(10) || chr(10) || '[Highlighted Evidence]' || chr(10) || e.body ELSE l.body END) AS context_md5
FROM l LEFT JOIN e USING (qa_key)""")
def contexts_rendered(spark: SparkSession, d: str) -> DataFrame:
    """The context of each question under its policy, as text (its digest)."""
    asked, placed = questions_of(spark, d), placed_of(spark, d)
    view = F.struct("turn", "speaker", "text", "spoken_at", "voice_style")
    local = u.session_views(asked, placed).groupBy("qa_key").agg(items.transcript(F.array_sort(F.collect_list(view))).alias("local"))
    at = placed.select("conversation_id", "session", "turn", "spoken_at", "voice_style")
    proof = u.evidence_rows(asked, placed).join(at, ["conversation_id", "session", "turn"])
    shown = F.struct("pos", F.col("evidence_speaker").alias("speaker"), F.col("evidence_text").alias("text"), "spoken_at", "voice_style")
    gold = proof.groupBy("qa_key").agg(items.transcript(F.array_sort(F.collect_list(shown))).alias("gold"))
    policy = F.when(F.col("qa_key") % 3 == 0, "session_local").when(F.col("qa_key") % 3 == 1, "gold_evidence").otherwise("session_local_plus_gold_evidence")
    both = local.join(gold, "qa_key", "left").withColumn("gold", F.coalesce("gold", F.lit(""))).withColumn("policy", policy)
    views = {"session_local": F.col("local"), "gold_evidence": F.col("gold"), "session_local_plus_gold_evidence": items.with_evidence(F.col("local"), F.col("gold"))}
    return both.select("qa_key", "policy", F.md5(items.context_of(F.col("policy"), views)).alias("context_md5"))


@query(W_Q + r"SELECT qa_key, trim(array_to_string([x FOR x IN [question_text, anchor_text, array_to_string([o FOR o IN answer_options IF o IS NOT NULL], ' ')] IF x IS NOT NULL AND x <> ''], ' ')) AS query_text FROM anchored")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    base = q.anchored(questions_of(spark, d), placed_of(spark, d))
    return base.select("qa_key", items.query_text(F.col("question_text"), F.col("anchor_text"), F.col("answer_options")).alias("query_text"))


@query(W_T + "SELECT conversation_id, CASE WHEN contains(coalesce(spoken_at, ''), 'T') THEN split_part(spoken_at, 'T', 1) WHEN coalesce(spoken_at, '') <> '' THEN spoken_at ELSE 'session_unknown' END AS session_key, count(*) AS n_turns FROM turns GROUP BY ALL")
def session_keys(spark: SparkSession, d: str) -> DataFrame:
    """Turns per conversation and day of speaking."""
    keyed = placed_of(spark, d).select("conversation_id", items.session_key(F.col("spoken_at")).alias("session_key"))
    return keyed.groupBy("conversation_id", "session_key").agg(F.count("*").alias("n_turns"))


_ISO = r"'^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})'"


@query(W_T + r"""SELECT conversation_id, dia_id, strftime(CASE WHEN o = '' OR o = 'Z' THEN l ELSE l - CASE WHEN left(o, 1) = '-' THEN -1 ELSE 1 END * (to_hours(CAST(o[2:3] AS INTEGER)) + to_minutes(CAST(o[5:6] AS INTEGER))) END, '%Y-%m-%d %H:%M:%S') AS utc
FROM (SELECT *, TRY_CAST(replace(left(spoken_at, 19), 'T', ' ') AS TIMESTAMP) AS l, regexp_extract(spoken_at, '(Z|[+-][0-9]{2}:[0-9]{2})$', 1) AS o FROM turns WHERE regexp_matches(spoken_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}')) WHERE l IS NOT NULL""")
def spoken_at_utc(spark: SparkSession, d: str) -> DataFrame:
    """Times of speaking as UTC; a time without offset counts as UTC."""
    rows = placed_of(spark, d).select("conversation_id", "dia_id", text.utc_time(F.col("spoken_at")).alias("t")).where("t is not null")
    return rows.select("conversation_id", "dia_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(_ITEMS + ", done AS (SELECT DISTINCT trim(coalesce(t ->> '$.question_text', '')) AS qt, trim(coalesce(anchor.text, '')) AS a FROM i WHERE unit_key % 2 = 0) SELECT unit_key FROM i WHERE NOT EXISTS (SELECT 1 FROM done WHERE qt = trim(coalesce(t ->> '$.question_text', '')) AND a = trim(coalesce(anchor.text, '')))")
def units_to_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Units without a finished one of the same question and anchor text (units of even key are finished)."""
    every = table(spark, d, "all_units")
    done = every.where("unit_key % 2 = 0").select(items.task("task_layer", "question_text").alias("question_text"), F.col("anchor.text").alias("anchor_text"))
    return items.to_repeat(every, done).select("unit_key")
