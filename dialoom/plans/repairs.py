"""Queries over repaired turns, annotations, contexts and questions, each with the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions import rules, text
from dialoom.operators import blueprint, repair, units
from dialoom.operators import questions as q
from dialoom.operators import turns as t
from dialoom.plans.problems import _number
from dialoom.plans.reference import _CONDITION, W_F, W_Q, W_T, _any, _level, features_of, placed_of, questions_of, turns_of
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


# ---- voices -----------------------------------------------------------------------------------


def _voices(spark: SparkSession, d: str) -> DataFrame:
    """Voice descriptions of turns, and such as annotators might write, with the emotion in them."""
    spoken = turns_of(spark, d).where("voice_style is not null").select("conversation_id", "dia_id", F.lit("turn").alias("origin"), "voice_style")
    told = F.concat_ws(" ", F.col("expression_style"), F.lit("and"), F.col("underlying_emotion"), F.lit(", showing a hint of"), F.col("secondary_emotion"))
    noted = table(spark, d, "annotation").select("conversation_id", "dia_id", F.lit("annotation").alias("origin"), told.alias("voice_style")).distinct()
    return spoken.unionByName(noted)


_VOICES = W_T + """, voices AS (SELECT conversation_id, dia_id, 'turn' AS origin, voice_style FROM turns WHERE voice_style IS NOT NULL
  UNION ALL SELECT DISTINCT conversation_id, dia_id, 'annotation', concat_ws(' ', expression_style, 'and', underlying_emotion, ', showing a hint of', secondary_emotion) FROM annotation)"""
_LEAKS = "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches({{v}}, '(?i)\\b({w})\\b') THEN '{k}' END" for k, w in [
    ("emotion_distress", "anxious|anxiety|apprehensive|nervous|worried|stressed|overwhelmed"), ("emotion_negative", "frustrated|frustration|defensive|disappointed|disappointment|ashamed|shame"),
    ("emotion_positive", "relieved|relief|grateful|gratitude|content|confident|hopeful|hurt"), ("emotion_other", "angry|anger|sad|fearful|afraid|resentful|embarrassed"),
    ("interpretive_verb", "masking|showing|revealing|indicating|suggesting|signifying|reflecting"), ("hidden_state_reference", "feeling|feels|emotion|emotional|underlying")]) + "] IF x IS NOT NULL]"


@query(_VOICES + f" SELECT conversation_id, dia_id, origin, array_to_string({_LEAKS.format(v='voice_style')}, ',') AS labels FROM voices WHERE len({_LEAKS.format(v='voice_style')}) > 0")
def voice_leaks(spark: SparkSession, d: str) -> DataFrame:
    rows = _voices(spark, d).withColumn("l", text.leak_labels(F.col("voice_style"))).where(F.size("l") > 0)
    return rows.select("conversation_id", "dia_id", "origin", F.array_join("l", ",").alias("labels"))


def _worded(x: str) -> str:
    for words, to in rules.VOICE_REWORDING:
        x = f"regexp_replace({x}, '(?i)\\b{words}\\b', '{to}', 'g')"
    return x


def _tidied(x: str) -> str:
    for pattern, to in rules.VOICE_FALLBACK:
        x = f"regexp_replace({x}, '(?i){pattern}', '{to}', 'g')"
    for pattern, to in ((r"(?i)\ba hint of\b", ""), (r"(?i)\bslight\b", "slightly"), (r"\s+,", ","), (r",\s*,", ", "), (r"\s{2,}", " "), (r"^[ ,]+|[ ,]+$", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_STYLED = f", once AS (SELECT *, {_tidied(_worded('voice_style'))} AS o FROM voices) SELECT conversation_id, dia_id, origin, CASE WHEN len({_LEAKS.format(v='o')}) > 0 THEN {_tidied('o')} ELSE o END AS voice_style FROM once"


@query(_VOICES + _STYLED)
def voice_styles_reworded(spark: SparkSession, d: str) -> DataFrame:
    return text.with_voice_reworded(_voices(spark, d), "voice_style")


# ---- turns and annotations ----------------------------------------------------------------------


_PAIRS = "pairs AS (SELECT conversation_id, coalesce(min(speaker_a), 'Teacher') AS first, coalesce(min(speaker_b), 'Student') AS second FROM conversation_head GROUP BY ALL)"


@query(W_T + f""", {_PAIRS}, g AS (SELECT *, max(CASE WHEN turn_index IS NOT NULL THEN history_pos END) OVER (PARTITION BY conversation_id ORDER BY history_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at FROM turns),
named AS (SELECT g.*, p.first, p.second, lower(trim(g.speaker)) AS low, coalesce(b.turn_index + g.history_pos - g.at, g.history_pos) AS filled_index FROM g LEFT JOIN turns b ON g.conversation_id = b.conversation_id AND g.at = b.history_pos LEFT JOIN pairs p ON g.conversation_id = p.conversation_id),
voices AS (SELECT *, CASE WHEN first IS NULL OR speaker IS NULL THEN speaker WHEN low IN ('', '...', 'teacher', 'psychological teacher', 'teacher persona', lower(first)) THEN first WHEN low IN ('student', 'student persona', lower(second)) THEN second ELSE speaker END AS name FROM named),
once AS (SELECT *, {_tidied(_worded('voice_style'))} AS o FROM voices)
SELECT conversation_id, dia_id, name AS speaker, filled_index, CASE WHEN len({_LEAKS.format(v='o')}) > 0 THEN {_tidied('o')} ELSE o END AS voice_style FROM once""")
def turns_repaired(spark: SparkSession, d: str) -> DataFrame:
    placed = checkpoint(placed_of(spark, d))  # read for the speakers and for the indexes
    return repair.turns_repaired(placed, table(spark, d, "conversation_head")).select("conversation_id", "dia_id", "speaker", "filled_index", "voice_style")


_SHAPED = "CASE WHEN coalesce(audio_id, '') = '' THEN ['text', 'voice_style'] ELSE list_concat(given, [x FOR x IN ['text', 'voice_style', 'audio'] IF NOT coalesce(list_contains(given, x), false)]) END"


@query(f"""SELECT conversation_id, dia_id, array_to_string({_SHAPED}, ',') AS modalities, len(coalesce(notes_for_dataset_builder.linked_event_ids, [])) AS n_linked, coalesce(notes_for_dataset_builder.is_candidate_emotion_anchor, false) AS emotion_anchor,
  coalesce(notes_for_dataset_builder.is_candidate_fact_anchor, false) AS fact_anchor, array_to_string([x FOR x IN [CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END, CASE WHEN trim(coalesce(voice_style, '')) = '' THEN 'voice_style' END] IF x IS NOT NULL], ',') AS missing
  FROM (SELECT *, coalesce(modality_available, ['text', 'voice_style', 'audio']) AS given FROM conversation)""")
def turn_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows, notes = repair.turn_shape(table(spark, d, "conversation")), F.col("notes_for_dataset_builder")
    return rows.select("conversation_id", "dia_id", F.array_join("modality_available", ",").alias("modalities"), F.size(notes["linked_event_ids"]).cast("bigint").alias("n_linked"),
                       notes["is_candidate_emotion_anchor"].alias("emotion_anchor"), notes["is_candidate_fact_anchor"].alias("fact_anchor"), F.array_join("missing", ",").alias("missing"))


_NAME = "CASE WHEN lower(trim({s})) IN ('teacher', 'psychological teacher', lower(first)) THEN first WHEN lower(trim({s})) IN ('student', lower(second)) THEN second ELSE {s} END"


@query(W_T + f""", {_PAIRS}, a AS (SELECT x.*, row_number() OVER () AS id, p.first, p.second, {_number("x.dia_id", 1)} AS s, {_number("x.dia_id", 2)} AS n FROM annotation x LEFT JOIN pairs p ON x.conversation_id = p.conversation_id),
own AS (SELECT a.*, coalesce(t.speaker, {_NAME.format(s="a.speaker")}) AS name FROM a LEFT JOIN turns t ON a.conversation_id = t.conversation_id AND a.s = t.session AND a.n = t.turn),
quotes AS (SELECT id, conversation_id, first, second, p, e, {_number("e.dia_id", 1)} AS s, {_number("e.dia_id", 2)} AS n FROM (SELECT *, evidence_turn_quotes[p] AS e FROM (SELECT *, unnest(range(1, len(evidence_turn_quotes) + 1)) AS p FROM a)) WHERE e IS NOT NULL),
said AS (SELECT q.id, string_agg(coalesce(q.e.dia_id, '') || '=' || coalesce(coalesce(t.speaker, {_NAME.format(s="q.e.speaker")}), '') || '=' || coalesce(q.e.text_evidence, ''), '|' ORDER BY q.p) AS quotes FROM quotes q LEFT JOIN turns t ON q.conversation_id = t.conversation_id AND q.s = t.session AND q.n = t.turn GROUP BY ALL)
SELECT conversation_id, dia_id, name AS speaker, {_level("memory_dependency_level", "'Level 0'")} AS level, len(coalesce(critical_event_ids, [])) AS n_events, len(coalesce(evidence_turn_ids, [])) AS n_evidence, coalesce(quotes, '') AS quotes, 'student' AS target_role FROM own LEFT JOIN said USING (id)""")
def annotations_repaired(spark: SparkSession, d: str) -> DataFrame:
    rows = repair.annotations_repaired(table(spark, d, "annotation"), placed_of(spark, d), table(spark, d, "conversation_head"))
    told = F.transform("evidence_turn_quotes", lambda x: F.concat_ws("=", *[F.coalesce(x[c], F.lit("")) for c in ("dia_id", "speaker", "text_evidence")]))
    return rows.select("conversation_id", "dia_id", "speaker", F.col("memory_dependency_level").alias("level"), F.size("critical_event_ids").cast("bigint").alias("n_events"),
                       F.size("evidence_turn_ids").cast("bigint").alias("n_evidence"), F.array_join(told, "|").alias("quotes"), "target_role")


@query(r"""SELECT qa_key, array_to_string(list_distinct_ordered, '|') AS together, array_to_string([x FOR x IN strs IF list_position([lower(y) FOR y IN strs], lower(x)) = list_position(strs, x)], '|') AS once,
  len(list_distinct([x FOR x IN a IF x IS NULL OR NOT list_contains(b, x)]) ) AS n_own
  FROM (SELECT qa_key, a, b, strs, [joined[i] FOR i IN range(1, len(joined) + 1) IF list_position(joined, joined[i]) = i] AS list_distinct_ordered
        FROM (SELECT qa_key, a, b, list_concat(b, a) AS joined, CASE WHEN len(s) > 0 THEN s ELSE ['none'] END AS strs
              FROM (SELECT qa_key, coalesce(key_explanation_points, []) AS a, coalesce(acceptable_answers, []) AS b, [trim(x) FOR x IN list_concat(coalesce(acceptable_answers, []), [upper(x) FOR x IN coalesce(acceptable_answers, [])]) IF x IS NOT NULL AND trim(x) <> ''] AS s FROM qa)))
""")
def answer_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of answers and points: merged, each once in any case, and the points that are no answers."""
    none = F.array().cast("array<string>")
    points, answers = F.coalesce("key_explanation_points", none), F.coalesce("acceptable_answers", none)
    named = repair.strings(F.concat(answers, F.transform(answers, F.upper)), "none")
    return table(spark, d, "qa").select(
        "qa_key", F.array_join(repair.merged(answers, points), "|").alias("together"), F.array_join(repair.once_in_any_case(named), "|").alias("once"),
        F.size(F.filter(repair.without(points, answers), lambda x: x.isNotNull())).cast("bigint").alias("n_own"),
    )


@query("SELECT unit_key, anchor.dia_id, anchor.speaker, anchor.text, anchor.turn_index_global FROM all_units")
def anchors_without_voice(spark: SparkSession, d: str) -> DataFrame:
    """Anchors without the members that tell of the voice."""
    return table(spark, d, "all_units").select("unit_key", F.col("anchor").dropFields("voice_style", "audio_id", "modality_available", "spoken_at").alias("anchor")).select("unit_key", "anchor.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM events")
def settings_merged(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events with those that override them."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    override = F.map_concat(F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.lit("x"))).otherwise(empty), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("kind"), F.col("event_type"))).otherwise(empty))
    both = table(spark, d, "events").select("event_id", repair.map_over(F.from_json("props", "map<string,string>"), override).alias("m"))
    return both.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("kind")).alias("kind"))


@query("SELECT doc_id, length(n) AS length FROM (SELECT doc_id, text, nfc_normalize(" + "replace(" * 9 + r"regexp_replace(text, '\x{a0}', ' ', 'g'), '²', '2'), '½', '1⁄2'), '№', 'No'), '𝒜', 'A'), '™', 'TM'), 'ﬁ', 'fi'), '…', '...'), '　', ' '), '，', ',')" + ") AS n FROM documents WHERE text IS NOT NULL) WHERE n <> text")
def compatibility_forms(spark: SparkSession, d: str) -> DataFrame:
    """Documents that compatibility normalisation changes, with their new length."""
    docs = table(spark, d, "documents").select("doc_id", "text", text.nfkc("text").alias("n")).where("text is not null and n <> text")
    return docs.select("doc_id", F.length("n").cast("bigint").alias("length"))


@query(r"""SELECT qa_key, coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(content_type, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'event') AS event_type, regexp_replace(conversation_id || '/' || question_id, '[^\p{L}\p{N}_-]', '_', 'g') AS folder,
  CASE WHEN length(f) > 40 THEN left(f, 37) || '...' ELSE f END AS short FROM (SELECT *, trim(regexp_replace(coalesce(question_text, ''), '[\s\p{Z}]+', ' ', 'g')) AS f FROM qa)""")
def names_made(spark: SparkSession, d: str) -> DataFrame:
    """Event types, folder names and short texts of questions."""
    return table(spark, d, "qa").select("qa_key", text.event_slug(F.col("content_type")).alias("event_type"), text.safe_name(F.concat("conversation_id", F.lit("/"), "question_id")).alias("folder"), text.shortened(F.col("question_text"), 40).alias("short"))


@query("""SELECT conversation_id, dia_id, array_to_string([x FOR x IN [trim(underlying_emotion), trim(secondary_emotion), trim(expression_style), 'People pleasing', trim(' ')] IF x IS NOT NULL AND x <> ''
  AND replace(lower(x), ' ', '_') NOT IN ('politeness', 'self_minimization', 'validation', 'directness', 'humor', 'joking', 'withdrawal', 'people_pleasing')], ',') AS emotions FROM annotation""")
def emotions_kept(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each annotation that may name an emotion."""
    terms = F.array("underlying_emotion", "secondary_emotion", "expression_style", F.lit("People pleasing"), F.lit(" "))
    return table(spark, d, "annotation").select("conversation_id", "dia_id", F.array_join(blueprint.without_non_emotions(terms), ",").alias("emotions"))


@query(W_T + " SELECT conversation_id, session, dia_id, speaker, text, 'start ' || session AS session_date_time FROM turns")
def documents_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Turns of nested documents, here one for each session, back as rows."""
    turn = F.struct("session_pos", F.struct("speaker", "dia_id", "text").alias("t"))
    each = placed_of(spark, d).groupBy("conversation_id", "session").agg(F.to_json(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"])).alias("turns"))
    key = F.concat(F.lit('"session_'), "session")
    value = F.concat(F.lit('{"conversation_id": "'), "conversation_id", F.lit('", '), key, F.lit('_date_time": "start '), "session", F.lit('", '), key, F.lit('": '), "turns", F.lit("}"))
    return t.flattened(each.select(value.alias("value"))).select("conversation_id", "session", "dia_id", "speaker", "text", "session_date_time")


# ---- contexts -----------------------------------------------------------------------------------


_C = f", c AS (SELECT *, {_CONDITION} AS condition FROM anchored WHERE anchor_id IS NOT NULL)"


@query(W_Q + _C + """ SELECT c.qa_key, t.dia_id, t.history_pos, c.condition, CASE WHEN c.condition IS NULL THEN NULL WHEN t.session = c.session AND t.turn >= c.turn - 1 AND c.condition = 'voice_style_missing' THEN 'unavailable'
  WHEN t.session = c.session AND t.turn >= c.turn - 1 AND c.condition = 'voice_style_ambiguous' AND t.voice_style IS NOT NULL THEN 'unclear' ELSE t.voice_style END AS masked_voice
FROM c JOIN turns t ON c.conversation_id = t.conversation_id AND (t.session < c.session OR (t.session = c.session AND t.turn <= c.turn))""")
def context_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of the full history of each question up to its anchor, plain and masked."""
    return units.history_views(questions_of(spark, d), placed_of(spark, d)).select("qa_key", "dia_id", "history_pos", "condition", "masked_voice")


@query(W_Q + """ SELECT a.qa_key, t.session, CAST((t.session_pos - 1) // 2 AS BIGINT) AS window_no, CAST((t.session_pos - 1) % 2 AS BIGINT) AS item_no, t.dia_id
FROM anchored a JOIN turns t ON a.conversation_id = t.conversation_id AND (t.session < a.session OR (t.session = a.session AND t.turn < a.turn)) WHERE a.anchor_id IS NOT NULL""")
def retrieval_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two turns strictly before each anchor, session by session."""
    rows = units.candidates(questions_of(spark, d), placed_of(spark, d))
    return rows.select("qa_key", "session", "window_no", F.col("item_no").cast("bigint").alias("item_no"), "dia_id")


@query(W_Q + f""", n AS (SELECT conversation_id, {_number("dia_id", 1)} AS s, {_number("dia_id", 2)} AS t, max(struct_pack(e := underlying_emotion, r := relation_state)) AS a FROM annotation WHERE {_number("dia_id", 1)} IS NOT NULL GROUP BY ALL),
h AS (SELECT a.qa_key, count(*) AS n_full FROM anchored a JOIN turns t ON a.conversation_id = t.conversation_id AND t.history_pos <= a.anchor_pos WHERE a.anchor_id IS NOT NULL GROUP BY ALL),
w AS (SELECT qa_key, count(*) AS n_windows FROM (SELECT DISTINCT a.qa_key, t.session, (t.session_pos - 1) // 2 AS no FROM anchored a JOIN turns t ON a.conversation_id = t.conversation_id AND t.history_pos < a.anchor_pos WHERE a.anchor_id IS NOT NULL) GROUP BY ALL)
SELECT 'U_' || a.question_id AS unit_id, a.qa_key, h.n_full, coalesce(w.n_windows, 0) AS n_windows, n.s IS NOT NULL AS annotated FROM anchored a JOIN h USING (qa_key) LEFT JOIN w USING (qa_key)
LEFT JOIN n ON a.conversation_id = n.conversation_id AND a.session = n.s AND a.turn = n.t WHERE a.anchor_id IS NOT NULL AND a.qa_key % 100 = 0""")
def whole_units(spark: SparkSession, d: str) -> DataFrame:
    """Units with their full contexts inside, of every hundredth question: sizes of the nested parts."""
    asked = checkpoint(questions_of(spark, d).where("qa_key % 100 = 0"))  # both are read several times
    heard = t.latest(table(spark, d, "conversation").join(asked.select("conversation_id").distinct(), "conversation_id", "left_semi"))
    placed = checkpoint(t.ordered(heard).drop("modality_available", "audio_id"))
    built = units.units(asked, table(spark, d, "annotation"), placed, whole=True)
    return built.select("unit_id", "qa_key", F.size("full_history_context").cast("bigint").alias("n_full"), F.coalesce(F.size("retrieval_candidates"), F.lit(0)).cast("bigint").alias("n_windows"), F.col("annotation").isNotNull().alias("annotated"))


# ---- questions ----------------------------------------------------------------------------------


@query(W_F + f""" SELECT qa_key, array_to_string([x FOR x IN [CASE WHEN n_evidence_sessions < 2 THEN 'single_session_evidence' END, CASE WHEN memory_level = 'Level 3' AND NOT early_evidence THEN 'level3_no_early_session_evidence' END,
  CASE WHEN memory_level = 'Level 2' AND n_evidence_sessions < 2 THEN 'level2_single_session_evidence' END, CASE WHEN memory_level = 'Level 1' THEN 'low_memory_level' END, CASE WHEN late_summary THEN 'late_summary_anchor' END,
  CASE WHEN question_type = 'retrieval' AND n_evidence <= 1 AND memory_level IN ('Level 0', 'Level 1') THEN 'shallow_retrieval' END] IF x IS NOT NULL], ',') AS hard_reasons,
 array_to_string([x FOR x IN [CASE WHEN is_last AND outcome THEN 'late_result_summary' END, CASE WHEN is_last AND late_summary THEN 'late_summary_anchor' END,
  CASE WHEN question_type = 'retrieval' AND n_evidence <= 1 AND memory_level IN ('Level 0', 'Level 1') THEN 'shallow_single_hop_retrieval' END,
  CASE WHEN question_type = 'judgment' AND is_last AND {_any("coalesce(anchor_text, '') || ' || ' || coalesce(question_text, '') || ' || ' || coalesce(gold_answer, '')", rules.GENERIC_JUDGMENT)} THEN 'late_generic_growth_judgment' END] IF x IS NOT NULL], ',') AS easy_reasons FROM features""")
def score_reasons(spark: SparkSession, d: str) -> DataFrame:
    return q.hard_reasons(features_of(spark, d))


_WORDING = r"trim(regexp_replace(lower(coalesce(question_text, '')), '[\s\p{Z}]+', ' ', 'g'))"


@query(f"WITH w AS (SELECT *, {_WORDING} AS wording FROM qa WHERE conversation_id IS NOT NULL AND anchor_dia_id IS NOT NULL AND anchor_dia_id <> '') SELECT qa_key, question_id, first AS repeats FROM (SELECT *, first_value(question_id) OVER (PARTITION BY conversation_id, anchor_dia_id, wording ORDER BY qa_key) AS first, row_number() OVER (PARTITION BY conversation_id, anchor_dia_id, wording ORDER BY qa_key) AS r FROM w WHERE wording <> '') WHERE r > 1")
def repeated_wording(spark: SparkSession, d: str) -> DataFrame:
    """Rows, older versions included, that repeat anchor and wording of an earlier one."""
    return q.repeated_wording(q.normalized(table(spark, d, "qa").where("conversation_id is not null")))


# every judgment gets a farewell, so that there are closing questions
@query("WITH RECURSIVE " + W_Q[5:] + r""", c AS (SELECT qa_key, conversation_id, question_type, list_sort(list_distinct([x FOR x IN evidence_turn_ids IF x IS NOT NULL AND trim(x) <> ''])) AS ids FROM questions WHERE question_type IN ('judgment', 'retrieval')),
n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, question_type ORDER BY qa_key) AS i FROM c WHERE len(ids) > 0),
s AS (SELECT conversation_id, question_type, 0::BIGINT AS i, NULL::BIGINT AS qa_key, NULL::BIGINT AS repeats_key, CAST([] AS STRUCT(k BIGINT, ids VARCHAR[])[]) AS kept FROM (SELECT DISTINCT conversation_id, question_type FROM n)
  UNION ALL SELECT n.conversation_id, n.question_type, n.i, n.qa_key, m.k, CASE WHEN m.k IS NULL THEN list_append(s.kept, struct_pack(k := n.qa_key, ids := n.ids)) ELSE s.kept END
  FROM s JOIN n ON n.conversation_id = s.conversation_id AND n.question_type = s.question_type AND n.i = s.i + 1,
  LATERAL (SELECT min(x.k) AS k FROM (SELECT unnest(s.kept) AS x) WHERE len(list_intersect(x.ids, n.ids)) >= 0.5 * len(list_distinct(list_concat(x.ids, n.ids)))) m)
SELECT qa_key, repeats_key FROM s WHERE repeats_key IS NOT NULL""")
def closure_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Closing questions that repeat an earlier kept one; every judgment and retrieval is given a farewell here."""
    f = features_of(spark, d).where("question_type in ('judgment', 'retrieval')").withColumn("question_text", F.concat(F.coalesce("question_text", F.lit("")), F.lit(" See you.")))
    return q.closure_repeats(f)


@query(W_F + """, ok AS (SELECT * FROM features WHERE NOT future_evidence AND NOT regexp_matches(coalesce(question_text, ''), '(?i)\\bsession\\s+\\d+\\b|\\bs\\d+\\b|\\bd\\d+:\\d+\\b')
  AND NOT ((question_type IN ('modality_missing', 'modality_ambiguous') OR modality_condition IN ('voice_style_removed', 'text_removed', 'modality_ambiguous', 'voice_style_ambiguous', 'text_ambiguous')) AND (contains(lower(coalesce(question_text, '')), 'instead of') OR regexp_matches(lower(coalesce(question_text, '')), '\\bif\\b.+\\bwas described as\\b')))
  AND NOT (coalesce(adversarial_type, '') = 'pseudo_conflict' AND regexp_matches(lower(coalesce(question_text, '')), '\\bif\\b.+\\bhad previously stated\\b'))
  AND NOT (question_type = 'retrieval' AND (starts_with(lower(coalesce(question_text, '')), 'explain ') OR contains(lower(coalesce(question_text, '')), ' how does it relate'))))
SELECT qa_key, format('Q{:03d}', row_number() OVER (PARTITION BY conversation_id ORDER BY qa_key)) AS question_id FROM ok""")
def questions_renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Questions that can be used, numbered anew in their conversation."""
    f = features_of(spark, d)
    return q.numbered(f.where(F.size(q.invalid_reasons(f)) == 0).select("conversation_id", "qa_key")).select("qa_key", "question_id")


@query(W_F + f""", x AS (SELECT *, n_evidence_sessions >= 2 AS two FROM features) SELECT conversation_id, CASE WHEN memory_level IN ('Level 2', 'Level 3') AND two THEN 'hard' ELSE 'support' END AS phase, count(*) AS n FROM x GROUP BY ALL""")
def phases_united(spark: SparkSession, d: str) -> DataFrame:
    """Hard and supporting questions, put together from their two phases."""
    f = features_of(spark, d)
    hard = f.where("memory_level in ('Level 2', 'Level 3') and n_evidence_sessions >= 2").select("conversation_id", "qa_key", F.lit("hard").alias("phase"))
    support = f.join(hard.select("qa_key"), "qa_key", "left_anti").select("conversation_id", "qa_key", F.lit("support").alias("phase"))
    return hard.unionByName(support).groupBy("conversation_id", "phase").agg(F.count("*").alias("n"))


@query(W_T + f""", a AS (SELECT DISTINCT conversation_id, dia_id, underlying_emotion, implicit_explicit, reasoning_structure, relation_state, memory_dependency_level FROM annotation WHERE conversation_id IS NOT NULL AND dia_id IS NOT NULL),
c AS (SELECT conversation_id, count(DISTINCT session) AS total FROM turns GROUP BY ALL),
j AS (SELECT a.*, {_number("a.dia_id", 1)} AS s, t.text, coalesce(c.total, 0) AS total FROM a LEFT JOIN turns t ON a.conversation_id = t.conversation_id AND {_number("a.dia_id", 1)} = t.session AND {_number("a.dia_id", 2)} = t.turn LEFT JOIN c ON a.conversation_id = c.conversation_id),
r AS (SELECT *, {_level("memory_dependency_level", "'Level 0'")} AS level FROM j), z AS (SELECT *, CASE level WHEN 'Level 3' THEN 6 WHEN 'Level 2' THEN 4 WHEN 'Level 1' THEN 1.5 ELSE 0 END
  + CASE WHEN reasoning_structure IN ('trajectory-based', 'conflict-resolution') THEN 2 WHEN reasoning_structure = 'multi-hop' THEN 1.5 WHEN reasoning_structure = 'single-hop' THEN 0.5 ELSE 0 END
  + CASE lower(coalesce(implicit_explicit, '')) WHEN 'implicit' THEN 1 WHEN 'explicit' THEN -0.5 ELSE 0 END + CASE WHEN relation_state IN ('mild_strain', 'strained', 'fragile') THEN 1 ELSE 0 END
  + CASE WHEN s > 0 AND total > 0 THEN CASE WHEN s = total THEN -1.5 WHEN s = total - 1 THEN -0.5 WHEN s <= 2 THEN 1 ELSE 0 END ELSE 0 END
  - CASE WHEN {_any("text", rules.LATE_SUMMARY)} THEN 5 + CASE WHEN s = total THEN 2 ELSE 0 END ELSE 0 END AS score FROM r)
SELECT conversation_id, dia_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, level DESC, coalesce(reasoning_structure, '') DESC, dia_id, underlying_emotion NULLS FIRST) AS rank FROM z) WHERE rank <= 10""")
def annotations_preferred(spark: SparkSession, d: str) -> DataFrame:
    """The ten annotated turns of each conversation that make the best anchors."""
    placed = placed_of(spark, d)
    rows = table(spark, d, "annotation").where("conversation_id is not null and dia_id is not null").select("conversation_id", "dia_id", "underlying_emotion", "implicit_explicit", "reasoning_structure", "relation_state", "memory_dependency_level").distinct()
    totals = placed.groupBy("conversation_id").agg(F.countDistinct("session").alias("total_sessions"))
    return q.best_annotations(q.annotation_scores(rows, placed, totals)).select("conversation_id", "dia_id", "rank")
