import random

from conftest import rows_of
from pyspark.sql import functions as F

from dialoom.operators import prefix


def test_totals_of_earlier_rows_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK", 3)
    rng = random.Random(1)
    rows = [(g, o, rng.randrange(9), rng.choice([None, rng.randrange(99)])) for g in "ab" for o in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint, m bigint")
    got = rows_of(prefix.before(df, ["g"], "o", {"s": F.col("v")}, {"top": F.col("m")}), "g", "o", "s", "top")
    want = []
    for g, o, _, _ in rows:
        earlier = [r for r in rows if r[0] == g and r[1] < o]
        want.append((g, o, sum(r[2] for r in earlier), max((r[3] for r in earlier if r[3] is not None), default=None)))
    assert got == sorted(want, key=repr)


def test_a_hot_key_is_spread(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', concat('k', id)) as k")
    small = spark.createDataFrame([("hot", 1), ("k950", 2)], "k string, v int")
    joined = prefix.salted_join(rows, small, ["k"], F.col("id"), "left")
    assert joined.count() == 1000 and joined.where("v = 1").count() == 900 and joined.where("v is null").count() == 99
    keys = rows.select(F.pmod(F.xxhash64("id"), F.lit(prefix.SALTS)).alias("s")).where("s is not null").distinct().count()
    assert keys == prefix.SALTS
