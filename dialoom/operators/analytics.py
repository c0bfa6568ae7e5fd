"""Score analytics over evaluation runs: means per group, summaries, cross-run filters, bottom k.

Scores are a long table (run, item, metric, value); item attributes are columns of an item table.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import rules


def rounded_mean(value: str | Column, digits: int = 3) -> Column:
    """Mean, rounded half up from its first nine decimals, so that the order of additions does not decide."""
    return F.round(F.avg(value).cast("decimal(28,9)"), digits).cast("double")


def group_mean(rows: DataFrame, group: str | Column, value: str, digits: int = 3) -> DataFrame:
    """Rows and mean per group; null and empty groups are 'unknown', the mean skips nulls."""
    key = F.col(group) if isinstance(group, str) else group
    named = F.when(key.isNull() | (key == ""), "unknown").otherwise(key)
    return rows.groupBy(named.alias("group")).agg(F.count("*").alias("count"), rounded_mean(value, digits).alias("mean"))


def summary(rows: DataFrame, groups: list[str], value: str, digits: int = 3) -> DataFrame:
    """Overall and per-group means in one pass (grouping sets): (dimension, group, count, mean)."""
    named = rows.select(value, *[F.when(F.col(g).isNull() | (F.col(g) == ""), "unknown").otherwise(F.col(g)).alias(g) for g in groups])
    spread = named.select(value, F.explode(F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("group")), *[F.struct(F.lit(g).alias("dimension"), F.col(g).alias("group")) for g in groups])).alias("g"))
    return spread.groupBy("g.dimension", "g.group").agg(F.count("*").alias("count"), rounded_mean(value, digits).alias("mean"))


def score_table(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run and item with a column per metric; values that are no numbers are left out.

    Of several scores of a metric the one of the last place (column ``pos``) counts.
    """
    numeric = scores.withColumn("value", F.col("value").try_cast("double")).where("value is not null and metric is not null")
    return numeric.groupBy("run", "item").pivot("metric", metrics).agg(F.max_by("value", "pos"))


def weighted_judgement(scores: Column) -> Column:
    """The judge's partial scores (a struct) under their weights."""
    return reduce(add, [scores[name] * weight for name, weight in rules.JUDGE_WEIGHTS.items()])


def effective(has_options: Column, exact: Column, judged: Column) -> Column:
    """The score that counts: exact match where there are options, else the judge's."""
    return F.when(has_options, exact).otherwise(judged)


def cross_run(scores: DataFrame, threshold: float, n_runs: int | None = None) -> DataFrame:
    """Per item over all runs: min, max, mean and whether every run reached the threshold.

    A run without the item, or a null score, fails the threshold; items without any score are left out.
    Of several scores of an item in a run the largest counts (``score_table`` picks the last one).
    """
    runs = scores.select("run").distinct().count() if n_runs is None else n_runs
    per_run = scores.groupBy("item", "run").agg(F.max("score").alias("score"))
    agg = per_run.groupBy("item").agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"),
        (F.count_if(F.col("score") >= threshold) == F.lit(runs)).alias("all_above"), (F.lit(runs) - F.count("score")).alias("n_missing"),
    )
    return agg.where("mean_score is not null").select("item", *[F.round(c, 3).alias(c) for c in ("min_score", "max_score", "mean_score")], "all_above", "n_missing")


def share_above(crossed: DataFrame, n_items: int | Column) -> DataFrame:
    """Number and percentage of the items that every run got right."""
    total = F.lit(n_items) if isinstance(n_items, int) else n_items
    easy = F.count_if(F.col("all_above"))
    return crossed.agg(easy.alias("n_easy"), F.when(total > 0, F.round(100 * easy / total, 1)).otherwise(0.0).alias("easy_pct"))


def bottom(rows: DataFrame, score: str, key: str, k: int = 5) -> DataFrame:
    """The k lowest rows; missing scores come last, ties by key (a top-k, not a full sort)."""
    return rows.orderBy(F.coalesce(score, F.lit(999.0)), F.coalesce(key, F.lit(""))).limit(k)


def collisions(rows: DataFrame, item_id: str, described: Column) -> DataFrame:
    """Ids that stand for more than one row, with how many and the first of them."""
    return rows.groupBy(item_id).agg(F.count("*").alias("n"), F.min(described).alias("first")).where("n > 1")


def retry(units: DataFrame, completed: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Units not completed, or completed with an error: one left join against the flags of both."""
    flags = (
        completed.select(F.col(key), F.lit(True).alias("__done"), F.lit(False).alias("__failed"))
        .unionByName(failed.select(F.col(key), F.lit(False).alias("__done"), F.lit(True).alias("__failed")))
        .groupBy(key).agg(F.max("__done").alias("__done"), F.max("__failed").alias("__failed"))
    )
    return units.join(flags, key, "left").where("__done is null or not __done or __failed").drop("__done", "__failed")
