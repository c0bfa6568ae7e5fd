"""Running totals inside large groups, without a window over a whole group.

A group is cut into blocks of ``BLOCK`` consecutive order values. Totals inside a block come from a
window over (group, block), those of earlier blocks from a window over one row per block. A group of a
billion rows is 250,000 small windows and one over as many rows. A join with a table of one row per
group spreads hot groups over ``SALTS`` keys instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SALTS = 4096, 32


def before(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """The rows with the sums (0 if none) and maxima (null if none) over all earlier rows of their group.

    ``order`` is a whole number that is unique in a group; ``maxima`` take structs too.
    """
    sums, maxima = sums or {}, maxima or {}
    values = {n: F.sum(c) for n, c in sums.items()} | {n: F.max(c) for n, c in maxima.items()}
    marked = rows.withColumn("__block", F.floor(F.col(order) / BLOCK))
    earlier = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.select("*", *[v.over(earlier).alias(f"__{n}") for n, v in values.items()])
    # the totals of the blocks come from rows that lie together already
    totals = inside.groupBy(*keys, "__block").agg(*[v.alias(f"__total_{n}") for n, v in values.items()])
    blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    known = totals.select(*keys, "__block", *[(F.sum if n in sums else F.max)(f"__total_{n}").over(blocks).alias(n) for n in values])
    both = [(F.coalesce(f"__{n}", F.lit(0)) + F.coalesce(n, F.lit(0))).alias(n) if n in sums else F.greatest(f"__{n}", n).alias(n) for n in values]
    return inside.join(known, [*keys, "__block"]).select(*rows.columns, *both)


def salted_join(rows: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join with a table of one row per key, a hot key being spread over ``salts`` tasks by the column ``spread``."""
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
