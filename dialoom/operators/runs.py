"""Evaluation runs as tables: observations, scores, rows per item, summaries, alignment of runs, reports.

Traces, observations, scores and dataset items are long tables; a run's rows come from equality joins
of them. Of observations and scores only one per trace (and metric) is kept, by aggregation before
the join, so a trace with very many of them is no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import text
from dialoom.operators import analytics

JUDGED = ["judge_core_answer_correct", "judge_key_point_coverage", "judge_rationale_alignment", "judge_unsupported_claims", "judge_insufficiency_handling"]
METRICS = ["exact_match", "llm_judge_final", *JUDGED]
# Columns of the table of a run, in this order
COLUMNS = ["question_id", "question_type", "content_type", "memory_level", "reasoning_structure", "modality_condition", "has_options", "context_policy", "effective_score", *METRICS,
           "prompt_tokens", "completion_tokens", "total_tokens", "generation_latency_seconds", "model_output", "gold_answer", "question_text", "trace_url"]


def longest(observations: DataFrame, kind: str, *columns: str) -> DataFrame:
    """(trace, columns) of the observation of a kind with the largest latency, the first on ties; null counts as 0."""
    picked = F.max_by(F.struct(*columns), F.struct(F.coalesce("latency", F.lit(0.0)), -F.col("pos")))
    return observations.where(F.col("kind") == kind).groupBy("trace").agg(picked.alias("__o")).select("trace", "__o.*")


def last_scores(scores: DataFrame) -> DataFrame:
    """(trace, scores): map of metrics to numbers; nulls and values that are no numbers are left out, the last one counts."""
    numeric = scores.withColumn("value", F.col("value").try_cast("double")).where("metric is not null and value is not null")
    each = numeric.groupBy("trace", "metric").agg(F.max_by("value", "pos").alias("value"))
    return each.groupBy("trace").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("scores"))


def text_at(value: Column, key: str) -> Column:
    """The member of a JSON text if it is a string, else null."""
    v = F.try_parse_json(value)
    inner = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def model_output(output: Column, generated: Column) -> Column:
    """Answer or content of the trace's output, else content of the generation's, else its plain text, else empty."""
    structured = F.coalesce(F.startswith(F.ltrim(generated), F.lit("{")) & F.try_parse_json(generated).isNotNull(), F.lit(False))
    plain = F.when(~structured, generated)
    return F.coalesce(text_at(output, "answer"), text_at(output, "content"), text_at(generated, "content"), plain, F.lit(""))


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def level_of_digit(level: Column) -> Column:
    return F.when(level.rlike("^[0-9]+$"), F.concat(F.lit("Level "), level)).otherwise(level)


def run_rows(run_items: DataFrame, items: DataFrame, traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per item of a run: run_items(item, trace) whose item is known, with what its trace gives, if anything."""
    generation = longest(observations, "GENERATION", "latency", "output", "prompt_tokens", "completion_tokens").select(
        "trace", F.col("latency").alias("generation_latency_seconds"), F.col("output").alias("__generated"), "prompt_tokens", "completion_tokens"
    )
    joined = run_items.join(items, "item").join(traces, "trace", "left").join(generation, "trace", "left").join(last_scores(scores), "trace", "left")
    metrics = [F.try_element_at("scores", F.lit(m)).alias(m) for m in METRICS]
    rows = joined.select("*", *metrics, (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens")).withColumn(
        "effective_score", analytics.effective(F.col("has_options"), F.col("exact_match"), F.col("llm_judge_final"))
    )
    policy = F.coalesce(text_at(F.col("output"), "context_policy"), F.lit("unknown"))
    return rows.withColumn("model_output", model_output(F.col("output"), F.col("__generated"))).withColumn("context_policy", policy).select("item", "trace", "scores", *COLUMNS)


def metric_means(rows: DataFrame, digits: int = 3) -> DataFrame:
    """Mean of each metric over the rows that have it, and of the effective score."""
    long = rows.select(F.explode(F.map_concat(F.coalesce("scores", F.map_from_arrays(F.array(), F.array()).cast("map<string,double>")), F.create_map(F.lit("effective_score"), F.col("effective_score").cast("double")))).alias("metric", "value"))
    return long.groupBy("metric").agg(analytics.rounded_mean("value", digits).alias("mean"), F.count("value").alias("n")).where("n > 0 or metric = 'effective_score'")


def grouped_means(rows: DataFrame, groups: list[str]) -> DataFrame:
    return analytics.summary(rows, groups, "effective_score")


def lowest(rows: DataFrame, score: str, k: int = 5) -> DataFrame:
    """Top-k report: the k rows of the lowest score, missing scores last, ties by question id."""
    shown = [text.shortened(F.col(c)).alias(c) for c in ("model_output", "gold_answer", "question_text")]
    return rows.orderBy(F.coalesce(score, F.lit(999.0)), F.coalesce("question_id", F.lit("")), "item").limit(k).select("item", "question_id", "question_type", score, *shown)


def aligned(scores: DataFrame) -> DataFrame:
    """(item, run, score) for every item of any run in every run; what a run lacks is null."""
    items, runs = scores.select("item").distinct(), [r["run"] for r in scores.select("run").distinct().orderBy("run").toLocalIterator()]  # runs: a short list
    spine = items.withColumn("run", F.explode(F.array(*map(F.lit, runs)))) if runs else items.withColumn("run", F.lit(None).cast("string"))
    return spine.join(scores.groupBy("item", "run").agg(F.max("score").alias("score")), ["item", "run"], "left")


def ranked_by_mean(crossed: DataFrame, k: int | None = None) -> DataFrame:
    """Items by falling mean score, ties by item, numbered; the first k if asked for."""
    order = crossed.orderBy(F.desc("mean_score"), "item")
    return (order.limit(k) if k else order).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_score"), "item"))) if k else order


def report(title: str, dataset: str, rows: DataFrame) -> str:
    """The run's report as Markdown; only its bounded tables reach the driver."""
    lines = [f"# Run analysis: {title}", "", f"- Dataset: `{dataset}`", f"- Items: `{rows.count()}`", "", "## Overall metrics", ""]
    lines += [f"- `{r['metric']}`: `{r['mean']}`" for r in metric_means(rows).orderBy("metric").toLocalIterator()]
    for column, name in (("question_type", "question type"), ("memory_level", "memory level"), ("content_type", "content type")):
        lines += ["", f"## By {name}", "", "| Group | Count | Mean effective score |", "| --- | ---: | ---: |"]
        lines += [f"| {r['group']} | {r['count']} | {'' if r['mean'] is None else r['mean']} |" for r in analytics.group_mean(rows, column, "effective_score").orderBy("group").toLocalIterator()]
    lines += ["", "## Lowest items", ""]
    for r in lowest(rows, "effective_score").toLocalIterator():
        lines += [f"### {r['question_id']} ({r['question_type']})", f"- Effective score: `{r['effective_score']}`", f"- Question: {r['question_text']}", f"- Model output: {r['model_output']}", f"- Gold answer: {r['gold_answer']}", ""]
    open_rows = rows.where("not has_options")
    lines += ["## Open questions with the lowest scores", ""]
    for r in lowest(open_rows, "llm_judge_final").toLocalIterator():
        lines += [f"### {r['question_id']}", f"- `llm_judge_final`: `{r['llm_judge_final']}`", f"- Question: {r['question_text']}", f"- Model output: {r['model_output']}", ""]
    return "\n".join(lines)
