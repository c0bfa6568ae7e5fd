"""Questions: latest version, normal form, evidence features, scores and curation.

Evidence is exploded once and met with the turns by one equality join; all per-question facts come
out of one aggregation by question. Scores are plain column expressions over those facts. Rankings
inside a conversation ask for a bounded rank, so that the engine limits each group before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import rules, text
from dialoom.functions.ids import is_blank, turn_numbers
from dialoom.operators.prefix import before as totals_before
from dialoom.operators.prefix import salted_join
from dialoom.session import checkpoint

COMPLEX = ("multi-hop", "trajectory-based", "conflict-resolution")


def latest(qa: DataFrame) -> DataFrame:
    """One row per conversation and question id: the one that arrived last, the larger key on ties."""
    newest = Window.partitionBy("conversation_id", "question_id").orderBy(F.desc_nulls_last("ingested_at"), F.desc("qa_key"))
    return qa.where("conversation_id is not null and question_id is not null").withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")


def normalized(qa: DataFrame) -> DataFrame:
    """Questions in normal form: enum tokens, reasoning names, level labels, arrays never null."""
    return qa.select(
        "qa_key", "conversation_id", "question_id", "anchor_dia_id", "question_text", "gold_answer", "gold_rationale",
        text.enum_token(F.col("question_type"), "judgment", rules.QUESTION_TYPE_ALIASES).alias("question_type"),
        text.enum_token(F.col("content_type"), "long_term_implicit_emotion").alias("content_type"),
        F.coalesce(text.reasoning(F.col("reasoning_structure")), F.lit("direct")).alias("reasoning_structure"),
        text.level_label(F.col("memory_level"), "Level 0").alias("memory_level"),
        text.enum_token(F.col("modality_condition"), "normal").alias("modality_condition"),
        F.coalesce("adversarial_flag", F.lit(False)).alias("adversarial_flag"),
        F.when(F.col("adversarial_flag"), text.enum_token(F.col("adversarial_type"), None)).alias("adversarial_type"),
        (~F.coalesce("adversarial_flag", F.lit(False)) & ~is_blank(F.col("adversarial_type"))).alias("type_without_flag"),
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("answer_options", "acceptable_answers", "critical_event_ids", "evidence_turn_ids", "key_explanation_points")],
    )


def anchored(questions: DataFrame, placed: DataFrame) -> DataFrame:
    """Questions with the session and turn their anchor names, and the anchor turn where it exists."""
    n = turn_numbers(F.col("anchor_dia_id"))
    named = questions.withColumn("session", n["session"]).withColumn("turn", n["turn"])
    at = placed.select(
        "conversation_id", "session", "turn", F.col("dia_id").alias("anchor_id"), F.col("text").alias("anchor_text"), F.col("turn_index").alias("anchor_index"),
        F.col("history_pos").alias("anchor_pos"), F.col("session_pos").alias("anchor_session_pos"), "sessions_before",
    )
    return named.join(at, ["conversation_id", "session", "turn"], "left")


def evidence(questions: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per visible evidence id: its place in the list, its numbers and the turn it names."""
    n = turn_numbers(F.col("raw"))
    rows = (
        questions.select("qa_key", "conversation_id", F.posexplode("evidence_turn_ids").alias("pos", "raw"))
        .where(~is_blank(F.col("raw")))
        .select("qa_key", "conversation_id", "pos", "raw", n["session"].alias("session"), n["turn"].alias("turn"))
    )
    at = placed.select("conversation_id", "session", "turn", "dia_id", F.col("text").alias("evidence_text"), F.col("speaker").alias("evidence_speaker"), "turn_index", "history_pos")
    return rows.join(at, ["conversation_id", "session", "turn"], "left")


def features(questions: DataFrame, placed: DataFrame) -> DataFrame:
    """All facts that the rules and scores need, one row per question."""
    base = anchored(questions, placed)
    keys = base.select("qa_key", F.col("anchor_index").alias("__ai"), F.col("session").alias("__as"))
    rows = evidence(questions, placed).join(keys, "qa_key")
    prior = F.col("turn_index") < F.col("__ai")
    facts = rows.groupBy("qa_key").agg(
        F.count("*").alias("n_evidence"),
        F.count("dia_id").alias("n_found"),
        F.count_if(prior).alias("n_prior"),
        F.countDistinct(F.when(prior, F.col("session"))).alias("n_prior_sessions"),
        F.coalesce(F.max(prior & (F.col("session") < F.col("__as"))), F.lit(False)).alias("earlier_session"),
        F.coalesce(F.max(F.col("turn_index") > F.col("__ai")), F.lit(False)).alias("future_evidence"),
        F.countDistinct("session").alias("n_evidence_sessions"),
        F.coalesce(F.max(F.col("__as") - F.col("session") >= 2), F.lit(False)).alias("early_evidence"),
    )
    n_sessions = placed.groupBy("conversation_id").agg(F.countDistinct("session").alias("total_sessions"))
    zero = {c: 0 for c in ("n_evidence", "n_found", "n_prior", "n_prior_sessions", "n_evidence_sessions", "total_sessions")}
    flags = ("earlier_session", "future_evidence", "early_evidence")
    out = salted_join(base.join(facts, "qa_key", "left"), n_sessions, ["conversation_id"], F.col("qa_key"), "left").na.fill(zero).na.fill({f: False for f in flags})
    late = text.has_any(F.col("anchor_text"), rules.LATE_SUMMARY)
    spoken = F.concat_ws(" || ", *[F.coalesce(c, F.lit("")) for c in ("anchor_text", "question_text", "gold_answer")])
    return (
        out.withColumn("inferred_level", inferred_level())
        .withColumn("anchor_session", F.coalesce("session", F.lit(-1)))
        .withColumn("late_summary", late)
        .withColumn("outcome", text.has_any(spoken, rules.OUTCOME))
        .withColumn("is_last", F.col("anchor_session") == F.col("total_sessions"))
    )


def inferred_level() -> Column:
    """Memory level from the evidence; the given one stays where the anchor is unknown."""
    return (
        F.when(F.col("anchor_id").isNull(), F.col("memory_level"))
        .when(F.col("n_prior") == 0, "Level 0")
        .when(~F.col("earlier_session"), "Level 1")
        .when((F.col("n_prior_sessions") >= 2) | (F.col("n_prior") >= 3), "Level 3")
        .otherwise("Level 2")
    )


def _points(*parts: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for condition, points in parts:
        total = total + F.when(condition, points).otherwise(0)
    return total


def scored(f: DataFrame) -> DataFrame:
    """Hard-core, final, late-result, same-anchor and easiness scores of the feature rows."""
    level, kind = F.col("memory_level"), F.col("question_type")
    two = F.col("n_evidence_sessions") >= 2
    hops = F.col("reasoning_structure").isin(*COMPLEX)
    low = level.isin("Level 0", "Level 1")
    shallow = (kind == "retrieval") & (F.col("n_evidence") <= 1) & low
    l3, l2, l1 = level == "Level 3", level == "Level 2", level == "Level 1"
    early, late, last, outcome = F.col("early_evidence"), F.col("late_summary"), F.col("is_last"), F.col("outcome")
    hard = _points((two, 3), (~two, -3), (l3 & early, 4), (l3 & ~early, -6), (l2 & two, 1), (l2 & ~two, -3), (l1, -2), (hops, 1), (late, -3), (shallow, -4))
    inner = (F.col("anchor_session") >= 2) & (F.col("anchor_session") <= F.greatest(F.lit(2), F.col("total_sessions") - 1))
    final = _points(
        (l3, 6), (l2, 4), (l1, 1), (level == "Level 0", -1), (l3 & ~early, -8), (two, 3), (~two & (l2 | l3), -3), (hops, 2),
        (F.col("reasoning_structure") == "direct", -1), ((kind == "retrieval") & (F.size("evidence_turn_ids") <= 1), -4),
        (late, -4), (outcome, -4), (last & low, -2), (last & outcome, -3), (inner, 1),
    )
    asked, told = F.col("question_text"), F.col("gold_answer")
    both = lambda marks: text.has_any(asked, marks) | text.has_any(told, marks)
    residue = _points((both(rules.RESIDUAL), 3), (both(rules.GROWTH), -2), (text.has_any(asked, rules.GENERIC_LATE), -1))
    spoken = F.concat_ws(" || ", *[F.coalesce(c, F.lit("")) for c in ("anchor_text", "question_text", "gold_answer")])
    easy = _points((last & outcome, 4), (last & late, 2), (shallow, 5), ((kind == "judgment") & last & text.has_any(spoken, rules.GENERIC_JUDGMENT), 2))
    content_bonus = F.col("content_type").isin("long_term_implicit_emotion", "relation_change", "relation_state")
    with_scores = f.withColumn("hard_score", hard).withColumn("final_score", final).withColumn("easy_score", easy)
    return with_scores.withColumn("late_score", F.col("final_score") + residue).withColumn(
        "anchor_score", F.col("final_score") + _points((kind == "retrieval", -2), (content_bonus, 1))
    )


def one_per_anchor(s: DataFrame) -> DataFrame:
    """The best question of each anchor (first on ties); questions without an anchor stay."""
    anchor = F.when(is_blank(F.col("anchor_dia_id")), F.concat(F.lit("~"), F.col("qa_key"))).otherwise(F.col("anchor_dia_id"))
    best = Window.partitionBy("conversation_id", anchor).orderBy(F.desc("anchor_score"), "qa_key")
    return s.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")


def without_easy(s: DataFrame, least: int = 4) -> DataFrame:
    return s.where(F.col("easy_score") < least)


def late_results_capped(s: DataFrame, most: int = 3, least: int = 4) -> DataFrame:
    """Of the late questions about outcomes at most ``most`` per conversation, and only good ones."""
    late = F.coalesce(F.col("is_last") & F.col("outcome"), F.lit(False))
    low = F.lower(F.coalesce("question_text", F.lit("")))
    generic = _points((F.contains(low, F.lit("overall demeanor")), 2), (F.contains(low, F.lit("relationship with")), 1), (F.contains(low, F.lit("how has")) & F.contains(low, F.lit("evolved")), 1))
    own = F.when(late, F.lit("late")).otherwise(F.col("qa_key").cast("string"))  # other rows are groups of their own
    rank = Window.partitionBy("conversation_id", own).orderBy(F.desc("late_score"), generic, "qa_key")
    kept = s.where(~late | (F.col("late_score") >= least))
    return kept.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= most).drop("__r")


def filled_to(s: DataFrame, target: int) -> DataFrame:
    """Up to ``target`` questions per conversation: the best of each session first, then by score."""
    session_best = Window.partitionBy("conversation_id", "anchor_session").orderBy(F.desc("final_score"), "qa_key")
    marked = s.withColumn("__best", (F.row_number().over(session_best) == 1) & (F.col("anchor_session") > 0))
    order = Window.partitionBy("conversation_id").orderBy(F.desc("__best"), F.desc("final_score"), "qa_key")
    return marked.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= target).drop("__best")


def curated(s: DataFrame, target: int = 12) -> DataFrame:
    return filled_to(late_results_capped(without_easy(one_per_anchor(s))), target)


def kept_or_demoted(s: DataFrame, least_kept: int) -> DataFrame:
    """Rows with ``kept``: score of 0 or more, or among the first ``least_kept`` of the conversation.

    Only as many negative rows per conversation are ranked as can be kept at all.
    """
    fine = s.groupBy("conversation_id").agg(F.count_if(F.col("hard_score") >= 0).alias("__fine"))
    order = Window.partitionBy("conversation_id").orderBy(F.desc("hard_score"), F.desc("memory_level"), F.desc("reasoning_structure"), "qa_key")
    saved = (
        s.where("hard_score < 0").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= least_kept)
        .join(fine, "conversation_id").where(F.col("__r") <= least_kept - F.col("__fine")).select("qa_key", F.lit(True).alias("__saved"))
    )
    return s.join(saved, "qa_key", "left").withColumn("kept", (F.col("hard_score") >= 0) | F.coalesce("__saved", F.lit(False))).drop("__saved")


def repeated_wording(questions: DataFrame) -> DataFrame:
    """Later questions of the same anchor and wording, with the first one they repeat."""
    same = questions.select("qa_key", "conversation_id", "question_id", "anchor_dia_id", text.signature(F.col("question_text")).alias("wording")).where(
        "anchor_dia_id is not null and anchor_dia_id <> '' and wording <> ''"
    )
    firsts = same.groupBy("conversation_id", "anchor_dia_id", "wording").agg(F.min(F.struct("qa_key", "question_id")).alias("first"))
    return same.join(firsts, ["conversation_id", "anchor_dia_id", "wording"]).where(F.col("qa_key") > F.col("first.qa_key")).select(
        "qa_key", "question_id", F.col("first.question_id").alias("repeats")
    )


def closure_repeats(f: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Closing questions that repeat an earlier kept one of the same type and half the evidence: (qa_key, repeats_key).

    A question is kept unless an earlier kept one is like it. Pairs that are alike share an evidence id,
    so they come from an equality join on (conversation, type, id); who is kept is then found in rounds:
    whoever has no earlier question left to wait for is kept, whoever has a kept earlier one is a repeat.
    Each round settles at least the first of every chain; no group is collected anywhere.
    """
    closing = text.has_any(F.concat_ws(" ", F.coalesce("question_text", F.lit("")), F.coalesce("anchor_text", F.lit(""))), rules.CLOSURE)
    ids = F.array_distinct(F.filter("evidence_turn_ids", lambda x: x.isNotNull() & (F.trim(x) != "")))
    rows = f.where(closing).select("conversation_id", "question_type", "qa_key", ids.alias("ids")).where("size(ids) > 0")
    long = rows.select("conversation_id", "question_type", "qa_key", F.size("ids").alias("n"), F.explode("ids").alias("id"))
    a, b = long.alias("a"), long.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("conversation_id", "question_type", "id")]
    shared = a.join(b, [*same, F.col("a.qa_key") < F.col("b.qa_key")]).groupBy(F.col("a.qa_key").alias("earlier"), F.col("b.qa_key").alias("later")).agg(F.count("*").alias("k"), F.first("a.n").alias("m"), F.first("b.n").alias("n"))
    edges = checkpoint(shared.where(F.col("k") >= overlap * (F.col("m") + F.col("n") - F.col("k"))).select("earlier", "later"))
    state = checkpoint(edges.select(F.explode(F.array("earlier", "later")).alias("qa_key")).distinct().select("qa_key", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast("bigint").alias("repeats_key")))
    while state.where("kept is null").limit(1).count():
        before = edges.join(state.select(F.col("qa_key").alias("earlier"), F.col("kept").alias("__kept")), "earlier")
        seen = before.groupBy(F.col("later").alias("qa_key")).agg(
            F.max(F.col("__kept").isNull()).alias("__open"), F.min(F.when(F.col("__kept"), F.col("earlier"))).alias("__first"), F.min(F.when(F.col("__kept").isNull(), F.col("earlier"))).alias("__waits")
        )
        joined = state.join(seen, "qa_key", "left")
        # a repeat names its first kept one, so it waits for open ones before that
        repeat = F.col("__first").isNotNull() & (~F.coalesce("__open", F.lit(False)) | (F.col("__first") < F.col("__waits")))
        free = ~F.coalesce("__open", F.lit(False)) & F.col("__first").isNull()
        settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(repeat, False).when(free, True)
        state = checkpoint(joined.select("qa_key", settled.alias("kept"), F.coalesce("repeats_key", F.when(F.col("kept").isNull() & repeat, F.col("__first"))).alias("repeats_key")))
    return state.where("not kept").select("qa_key", "repeats_key")


def level_spans(f: DataFrame) -> DataFrame:
    """(qa_key, rule): questions of level 2 or 3 whose evidence does not span what the level says."""
    level, two = F.col("memory_level"), F.col("n_evidence_sessions") >= 2
    rule = F.when((level == "Level 3") & ~F.col("early_evidence"), "level3_without_wide_span").when((level == "Level 3") & ~two, "level3_in_one_session").when((level == "Level 2") & ~two, "level2_in_one_session")
    return f.select("qa_key", rule.alias("rule")).where("rule is not null")


def hard_reasons(f: DataFrame) -> DataFrame:
    """(qa_key, hard_reasons, easy_reasons): why a question lost points as a hard one, and won some as an easy one."""
    level, two, last = F.col("memory_level"), F.col("n_evidence_sessions") >= 2, F.col("is_last")
    shallow = (F.col("question_type") == "retrieval") & (F.col("n_evidence") <= 1) & level.isin("Level 0", "Level 1")
    spoken = F.concat_ws(" || ", *[F.coalesce(c, F.lit("")) for c in ("anchor_text", "question_text", "gold_answer")])
    hard = [(~two, "single_session_evidence"), ((level == "Level 3") & ~F.col("early_evidence"), "level3_no_early_session_evidence"), ((level == "Level 2") & ~two, "level2_single_session_evidence"),
            (level == "Level 1", "low_memory_level"), (F.col("late_summary"), "late_summary_anchor"), (shallow, "shallow_retrieval")]
    easy = [(last & F.col("outcome"), "late_result_summary"), (last & F.col("late_summary"), "late_summary_anchor"), (shallow, "shallow_single_hop_retrieval"),
            ((F.col("question_type") == "judgment") & last & text.has_any(spoken, rules.GENERIC_JUDGMENT), "late_generic_growth_judgment")]
    named = lambda checks: F.array_join(F.array_compact(F.array(*[F.when(c, n) for c, n in checks])), ",")
    return f.select("qa_key", named(hard).alias("hard_reasons"), named(easy).alias("easy_reasons"))


def best_annotations(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` annotated turns preferred as anchors of each conversation, numbered; all others are discouraged.

    By score, level, reasoning and id, so negative scores come in only where there are too few others.
    The rank is bounded, so each group is cut before the shuffle.
    """
    level = text.level_label(F.col("memory_dependency_level"), "Level 0")
    order = Window.partitionBy("conversation_id").orderBy(F.desc("score"), F.desc(level), F.desc(F.coalesce("reasoning_structure", F.lit(""))), "dia_id", F.asc_nulls_first("underlying_emotion"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbered(rows: DataFrame, pattern: str = "Q%03d") -> DataFrame:
    """Questions numbered anew inside their conversation by key; counting goes in blocks of keys."""
    counted = totals_before(rows, ["conversation_id"], "qa_key", {"__n": F.lit(1)})
    return counted.withColumn("question_id", F.format_string(pattern, (F.col("__n") + 1).cast("int"))).drop("__n")


def curation_tags(f: DataFrame, repeats: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(qa_key, tags): tags of doubt about a question, joined by commas; ``signals`` are repeats of closing questions."""
    level, kind, hops = F.col("memory_level"), F.col("question_type"), F.col("reasoning_structure")
    low = level.isin("Level 0", "Level 1")
    closing = text.has_any(F.concat_ws(" ", F.coalesce("question_text", F.lit("")), F.coalesce("anchor_text", F.lit(""))), rules.CLOSURE)
    tags = F.array(
        F.when((low & hops.isin("direct", "single-hop")) | ((kind == "retrieval") & F.col("content_type").isin("near_term_fact", "long_term_fact") & (level == "Level 0")), "likely_easy"),
        F.when((kind == "retrieval") & ((F.col("content_type") == "near_term_fact") | (level == "Level 0") | (hops == "direct")), "likely_low_value_retrieval"),
        F.when(closing, "closure_signal"),
        F.when(F.col("__repeated"), "likely_duplicate_wording"),
        F.when(F.col("__signal"), "likely_duplicate_signal"),
        F.when((F.col("n_evidence") <= 1) & low, "thin_evidence"),
    )
    marked = f.join(repeats.select("qa_key", F.lit(True).alias("__repeated")), "qa_key", "left")
    marked = marked.withColumn("__signal", F.lit(False)) if signals is None else marked.join(signals.select("qa_key", F.lit(True).alias("__signal")), "qa_key", "left")
    return marked.select("qa_key", F.array_join(F.array_compact(tags), ",").alias("tags"))


def invalid_reasons(f: DataFrame) -> Column:
    """Reasons why a question cannot be used, as an array in a fixed order."""
    low = F.lower(F.coalesce("question_text", F.lit("")))
    marked = F.col("question_type").isin("modality_missing", "modality_ambiguous") | F.col("modality_condition").isin(*rules.MODALITY_MARKED)
    replaced = F.contains(low, F.lit("instead of")) | low.rlike(r"\bif\b.+\bwas described as\b")
    return F.array_compact(
        F.array(
            F.when(F.col("future_evidence"), "future_evidence"),
            F.when(marked & replaced, "replacement_cue"),
            F.when((F.col("adversarial_type") == "pseudo_conflict") & low.rlike(r"\bif\b.+\bhad previously stated\b"), "fabricated_prior"),
            F.when((F.col("question_type") == "retrieval") & (F.startswith(low, F.lit("explain ")) | F.contains(low, F.lit(" how does it relate"))), "explanatory_retrieval"),
            F.when(F.coalesce("question_text", F.lit("")).rlike(rules.FORBIDDEN_REFERENCE), "names_session_or_turn"),
        )
    )


def annotation_scores(annotations: DataFrame, placed: DataFrame, total_sessions: DataFrame, closure_profile: str | None = None) -> DataFrame:
    """Worth of annotated turns as anchors of hard questions (higher is better)."""
    n = turn_numbers(F.col("dia_id"))
    a = annotations.withColumn("session", n["session"]).withColumn("turn", n["turn"])
    at = placed.select("conversation_id", "session", "turn", F.col("text").alias("__text"))
    a = salted_join(a.join(at, ["conversation_id", "session", "turn"], "left"), total_sessions, ["conversation_id"], F.col("dia_id"), "left")
    level = text.level_label(F.col("memory_dependency_level"), "Level 0")
    how, total = F.lower(F.coalesce("implicit_explicit", F.lit(""))), F.coalesce("total_sessions", F.lit(0))
    late, last = text.has_any(F.col("__text"), rules.LATE_SUMMARY), F.col("session") == total
    part = lambda c, p: F.when(c, F.lit(float(p))).otherwise(0.0)
    place = F.when((F.col("session") > 0) & (total > 0), F.when(last, -1.5).when(F.col("session") == total - 1, -0.5).when(F.col("session") <= 2, 1.0).otherwise(0.0)).otherwise(0.0)
    score = (
        part(level == "Level 3", 6) + part(level == "Level 2", 4) + part(level == "Level 1", 1.5)
        + part(F.col("reasoning_structure").isin("trajectory-based", "conflict-resolution"), 2) + part(F.col("reasoning_structure") == "multi-hop", 1.5)
        + part(F.col("reasoning_structure") == "single-hop", 0.5) + part(how == "implicit", 1) - part(how == "explicit", 0.5)
        + part(F.col("relation_state").isin("mild_strain", "strained", "fragile"), 1) + place - part(late, 5) - part(late & last, 2)
    )
    if closure_profile in ("surface_closure_hidden_residue", "practical_progress_relational_residue"):
        score = score - part(last & text.has_any(F.col("__text"), rules.SURFACE_CLOSURE), 3)
    return a.withColumn("score", score).drop("__text", "total_sessions")
