"""Samples with wanted category shares: the cube method in parallel flight phases.

A plan wants ``sample_size`` rows with given shares of one field's categories and a minimum from
each. The allocation turns that into a number per category: the shares by largest remainders, raised
to the minimum, taken from the categories above theirs, and never more than there are rows. Every
row then has the inclusion probability (allocated / available) of its category.

The balancing variables are the indicators of the categories of all fields at once: those of the
plan's own field, and those of the other fields, whose shares in the sample shall be the ones the
probabilities imply. Rows that agree in all fields form a cell and have the same indicators.

Flight: each partition reads its rows in an order given by a hash. The rows of one cell that come
together are moved at once: among rows of equal probability and equal indicators, whole shares are
taken in random order and one row is left with the remainder, which keeps all totals. Rows left over
meet those of other cells in a window of one row more than there are variables; there the null space
of the indicators has a direction that keeps all totals, and the rows move along it until one is
decided. So at most as many rows as variables stay undecided in a partition. Only these go up to a
merging flight of at most ``FAN_IN`` partitions in one task, and so on to one. Landing drops the
variables of the other fields one after the other and flies on; those of the plan's own field stay,
and as their totals are whole numbers, they are met exactly. What the dropped variables cost is
reported as the residual imbalance of each indicator. Random numbers come from a hash of seed, plan
and key, and every flight reads its rows in a fixed order, so that a lost task repeats the same sample.

Defined cases: rows of null or other categories of the plan's field are not eligible; in another field
they are a category like any other; a plan whose field is unknown gets only shortages; fewer rows than
wanted means all of them; repeated rows count each; an empty table gives no rows and all shortages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.canonical import FIELDS, entries_resolved
from dialoom.session import checkpoint

#: Fields whose categories are balanced; those of canonical.FIELDS are resolved first.
BALANCED = ("content_type", "memory_level", "reasoning_structure", "question_type")
FAN_IN = 256
EPS = 1e-9
FLIGHT = "plan_id string, qa_key bigint, prob double, taken boolean, " + ", ".join(f"{f} string" for f in BALANCED)
COLUMNS = [c.split()[0] for c in FLIGHT.split(", ")]


def categories(spark: SparkSession, qa: DataFrame, canon: DataFrame) -> DataFrame:
    """(qa_key, one column per field): resolved categories of every row, null where there is none.

    Only entries that are no canonical value are looked up; they meet their rows again by key, so the
    few values that most rows have are no keys of a shuffle.
    """
    strange = entries_resolved(spark, qa, canon)
    entry = F.concat_ws("\n", "field_name", "entry")
    known = strange.groupBy("qa_key").agg(F.map_from_entries(F.collect_set(F.struct(entry.alias("k"), F.col("canonical_value").alias("v")))).alias("__known"))
    joined = qa.select("qa_key", *BALANCED).join(known.hint("merge"), "qa_key", "left")
    resolved = [F.coalesce(F.col("__known")[F.concat_ws("\n", F.lit(f), F.col(f))], F.col(f)).alias(f) if f in FIELDS else F.col(f) for f in BALANCED]
    return joined.select("qa_key", *resolved)


def targets(plans: DataFrame) -> DataFrame:
    """Wanted rows per plan and category as the plan states them: the larger of minimum and share, rounded up."""
    share = F.ceil(F.col("target_pct").cast("bigint") * F.col("sample_size") / F.lit(100.0)).cast("bigint")
    return plans.select(
        "plan_id", "field_name", "category", "sample_size", "target_pct", "min_rows",
        F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), F.coalesce(share, F.lit(0).cast("bigint"))).alias("wanted"),
    )


def availability(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The targets with the number of rows there are for each (0 where none); one row per cell is counted first."""
    cells = rows.groupBy(*BALANCED).agg(F.count("*").alias("n"))
    long = cells.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("category")) for f in BALANCED])).alias("c"))
    counts = long.groupBy("c.field_name", "c.category").agg(F.sum("n").alias("available"))
    return targets(plans).join(counts, ["field_name", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))


def allocate(size: int, shares: list[float], minimums: list[int], available: list[int]) -> list[int]:
    """Rows to take per category: largest remainders, minimums first, never beyond what there is."""
    total = sum(shares) or 1
    quota = [size * s / total for s in shares]
    got = [int(q) for q in quota]
    for i in sorted(range(len(quota)), key=lambda i: (got[i] - quota[i], i))[: size - sum(got)]:
        got[i] += 1
    least = [min(m, a) for m, a in zip(minimums, available)]
    got = [max(min(g, a), m) for g, a, m in zip(got, available, least)]
    while (over := sum(got) - size) != 0:
        room = [i for i in range(len(got)) if (got[i] > least[i] if over > 0 else got[i] < available[i])]
        if not room:
            break
        i = max(room, key=lambda i: ((got[i] - quota[i]) * (1 if over > 0 else -1), -i))
        got[i] += -1 if over > 0 else 1
    return got


def chances(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each key and the seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def within_cells(cell: np.ndarray, prob: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """New probabilities after a flight inside each group of equal cell and probability.

    In random order the first rows get 1, as many as the total holds whole, the next one the rest, the
    others 0: every row's expectation is its probability, and each cell's total stays.
    """
    order = np.lexsort((chance, prob, cell))
    c, p = cell[order], prob[order]
    first = np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])] if len(c) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(c)])
    total = np.repeat(sizes * p[starts], sizes) if len(starts) else np.zeros(0)
    whole = np.floor(total + EPS)
    rank = np.arange(len(c)) - np.repeat(starts, sizes)
    moved = np.where(rank < whole, 1.0, np.where(rank == whole, np.maximum(total - whole, 0.0), 0.0))
    out = np.empty(len(c))
    out[order] = np.where((p <= EPS) | (p >= 1 - EPS), np.round(p), moved)
    return out


def null_direction(balance: np.ndarray) -> np.ndarray | None:
    """A vector u of norm 1 with balance.T @ u = 0 (rows x variables), None if there is none."""
    if not balance.shape[1]:
        return np.eye(1, len(balance))[0]
    _, s, vt = np.linalg.svd(balance.T, full_matrices=True)
    return vt[-1] if int((s > 1e-9).sum()) < len(balance) else None


def across_cells(indicators: np.ndarray, prob: np.ndarray, lots: np.random.Generator) -> np.ndarray:
    """New probabilities after a flight over rows with these balancing variables (rows x variables).

    The window holds one row more than there are variables and is filled up in order; of the two ways
    along the direction one is chosen so that expectations stay. Ends when no direction is left.
    """
    p = prob.astype(float).copy()
    waiting = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    at, window = 0, []
    most = indicators.shape[1] + 1
    while True:
        while len(window) < most and at < len(waiting):
            window.append(waiting[at])
            at += 1
        used = indicators[window]
        u = null_direction(used[:, used.any(0)]) if window else None
        if u is None:
            return p
        now = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > EPS, (1 - now) / u, np.where(u < -EPS, -now / u, np.inf)).min()
            down = np.where(u > EPS, now / u, np.where(u < -EPS, (now - 1) / u, np.inf)).min()
        moved = now + u * (up if lots.random() * (up + down) < down else -down)
        moved[moved < 1e-7], moved[moved > 1 - 1e-7] = 0.0, 1.0
        p[window] = moved
        window = [i for i in window if 0.0 < p[i] < 1.0]


def matrix(rows: pd.DataFrame, fields: list[str]) -> np.ndarray:
    """Indicators of the categories of the fields, null being one of them."""
    parts = [pd.factorize(rows[f], use_na_sentinel=False) for f in fields]
    return np.hstack([np.eye(len(names))[codes] if len(names) else np.zeros((len(rows), 0)) for codes, names in parts]) if parts else np.zeros((len(rows), 0))


def flown(rows: pd.DataFrame, own: str, seed: int, landing: bool = False) -> pd.DataFrame:
    """One flight over the rows of a plan: first inside the cells, then across them, then landing if asked for."""
    rows = rows.reset_index(drop=True)
    chance = chances(rows.qa_key.to_numpy(), seed)
    cell = rows.groupby(list(BALANCED), dropna=False, sort=False).ngroup().to_numpy()
    prob = within_cells(cell, rows.prob.to_numpy(float), chance)
    others = [f for f in BALANCED if f != own]
    left = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    for kept in range(len(others), -1 if landing else len(others) - 1, -1):
        if not len(left):
            break
        order = left[np.lexsort((rows.qa_key.to_numpy()[left], chance[left]))]
        lots = np.random.default_rng([seed, kept, *(int(k) & (1 << 64) - 1 for k in rows.qa_key.to_numpy()[order[:2]])])
        prob[order] = across_cells(matrix(rows.iloc[order], [own, *others[:kept]]), prob[order], lots)
        left = np.flatnonzero((prob > EPS) & (prob < 1 - EPS))
    if landing and len(left):  # totals that are no whole numbers: the most probable rows up to the rounded total
        order = left[np.lexsort((rows.qa_key.to_numpy()[left], -prob[left]))]
        take = pd.Series(prob[order]).groupby(rows[own].iloc[order].to_numpy(), dropna=False)
        prob[order] = (take.cumcount() < take.transform("sum").round()).astype(float)
    return rows.assign(prob=prob, taken=np.where(prob >= 1 - EPS, True, np.where(prob <= EPS, False, None)))


def _fly(own: dict[str, str], seed: int, landing: bool = False):
    """Flights over the sorted rows of a partition; rows decided against are dropped, undecided ones are kept to the end."""
    seeds = {plan: seed * 1_000_003 + i for i, plan in enumerate(sorted(own))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, pd.DataFrame] = {}

        def fly(plan: str, rows: pd.DataFrame, landing: bool) -> pd.DataFrame:
            after = flown(rows, own[plan], seeds[plan], landing)
            waiting[plan] = after[after.taken.isna()]
            return after[after.taken == True][COLUMNS].astype({"taken": object})  # noqa: E712

        for batch in batches:
            for plan, rows in batch.groupby("plan_id", sort=True):
                yield fly(plan, pd.concat([waiting[plan], rows]) if plan in waiting and len(waiting[plan]) else rows, False)
        for plan in sorted(waiting):
            if landing and len(waiting[plan]):
                yield fly(plan, waiting[plan], True)
            yield waiting[plan][COLUMNS].astype({"taken": object})

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("plan_id", F.xxhash64("qa_key"), "qa_key", *BALANCED)


def balanced_sample(spark: SparkSession, qa: DataFrame, canon: DataFrame, plans: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chosen rows, the allocation per plan and category, and the expected totals of all indicators.

    The plans are a short list that people write (tens of rows); they are read by the driver.
    """
    everything = checkpoint(categories(spark, qa, canon))
    known = [r.asDict() for r in availability(everything, plans).where("category is not null").orderBy("plan_id", "category").toLocalIterator()]
    alloc, own = [], {}
    for plan in sorted({r["plan_id"] for r in known}):
        rows = [r for r in known if r["plan_id"] == plan]
        got = allocate(rows[0]["sample_size"] or 0, [float(r["target_pct"] or 0) for r in rows], [r["min_rows"] or 0 for r in rows], [r["available"] for r in rows])
        own[plan] = rows[0]["field_name"]
        alloc += [(plan, r["field_name"], r["category"], r["sample_size"], r["target_pct"], r["min_rows"], r["wanted"], r["available"], g) for r, g in zip(rows, got)]
    schema = "plan_id string, field_name string, category string, sample_size int, target_pct int, min_rows int, wanted bigint, available bigint, allocated bigint"
    allocation = spark.createDataFrame(alloc, schema)
    chosen_rates: dict[str, dict[str, list]] = {}
    for plan, field, category, *_, available, g in alloc:
        if g and field in BALANCED:
            chosen_rates.setdefault(field, {}).setdefault(category, []).append((plan, g / available))
    struct = "array<struct<plan_id:string,prob:double>>"
    rates = [
        F.coalesce(F.create_map(*[x for c, rs in by.items() for x in (F.lit(c), F.array(*[F.struct(F.lit(p).alias("plan_id"), F.lit(q).alias("prob")) for p, q in rs]))])[F.col(field)], F.array().cast(struct))
        for field, by in chosen_rates.items()
    ]
    eligible = everything.select("qa_key", *BALANCED, F.explode(F.concat(*rates) if rates else F.array().cast(struct)).alias("r")).select("r.plan_id", "qa_key", "r.prob", *BALANCED)
    expected = eligible.groupBy("plan_id", *BALANCED).agg(F.count("*").alias("n"), F.sum("prob").alias("expected"))
    rows = eligible.select("plan_id", "qa_key", "prob", F.lit(None).cast("boolean").alias("taken"), *BALANCED)
    step = checkpoint(_ordered(rows).mapInPandas(_fly(own, seed), FLIGHT))
    chosen = [step.where("taken")]
    parts = step.rdd.getNumPartitions()
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        step = checkpoint(_ordered(step.where("taken is null").repartition(parts, F.xxhash64("qa_key"))).mapInPandas(_fly(own, seed), FLIGHT))
        chosen.append(step.where("taken"))
    chosen.append(checkpoint(_ordered(step.where("taken is null").coalesce(1)).mapInPandas(_fly(own, seed, landing=True), FLIGHT)).where("taken"))
    return reduce(DataFrame.unionByName, chosen).drop("prob", "taken"), allocation, expected


def balance_report(sample: DataFrame, allocation: DataFrame) -> DataFrame:
    """Wanted, allocated and drawn rows per plan and category of its field, and what is missing."""
    own = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f)) for f in BALANCED])
    fields = allocation.select("plan_id", "field_name").distinct()
    drawn = sample.join(F.broadcast(fields), "plan_id").groupBy("plan_id", own.alias("category")).agg(F.count("*").alias("drawn"))  # a row per plan
    return allocation.join(drawn, ["plan_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint"))).select(
        "plan_id", "category", "sample_size", "target_pct", "min_rows", "wanted", "available", "allocated", "drawn",
        (F.col("drawn") - F.col("allocated")).alias("residual"), F.greatest(F.col("wanted") - F.col("drawn"), F.lit(0).cast("bigint")).alias("missing"),
        F.greatest(F.col("wanted") - F.col("available"), F.lit(0).cast("bigint")).alias("shortage"),
    )


def residuals(sample: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and drawn rows of every indicator of every plan; the difference is the residual imbalance."""
    drawn = sample.groupBy("plan_id", *BALANCED).agg(F.count("*").alias("drawn"))
    both = expected.select("plan_id", *BALANCED, "expected", F.lit(0).cast("bigint").alias("drawn")).unionByName(drawn.withColumn("expected", F.lit(0.0)))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("category")) for f in BALANCED])
    long = both.select("plan_id", "expected", "drawn", F.explode(fields).alias("c"))
    return long.groupBy("plan_id", "c.field_name", "c.category").agg(F.round(F.sum("expected"), 6).alias("expected"), F.sum("drawn").alias("drawn")).withColumn(
        "residual", F.round(F.col("drawn") - F.col("expected"), 6)
    )


def shortages(spark: SparkSession, qa: DataFrame, canon: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, category) of the targets the sample misses because there are too few rows."""
    sample, allocation, _ = balanced_sample(spark, qa, canon, plans)
    return balance_report(sample, allocation).where("missing > 0 and shortage > 0").select("plan_id", "category")
