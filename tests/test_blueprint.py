from conftest import rows_of
from pyspark.sql import functions as F

from dialoom.operators import blueprint as b
from dialoom.operators.repair import canonical_speaker


def test_spans_and_stages(spark):
    spans = spark.range(1, 4).select(F.col("id").cast("int").alias("n")).select("n", b.default_span(F.col("n"), F.lit(3), F.lit(5)).alias("s"))
    assert rows_of(spans, "n", "s") == [(1, [1, 2]), (2, [3, 3][:1]), (3, [4, 5])]
    stages = spark.createDataFrame([("x", "S1", 1, [1, 2]), ("x", "S2", 2, [2, 3])], "scenario string, stage_id string, stage_no int, session_span array<int>")
    scripts = spark.createDataFrame([("x", 1, 12), ("x", 2, 4), ("x", 3, 1), ("x", 9, 4)], "scenario string, session int, turn_count int")
    assert rows_of(b.stage_of_session(scripts, stages), "session", "stage_id") == [(1, "S1"), (2, "S1"), (3, "S2"), (9, "S2")]
    events = spark.createDataFrame([("x", "E1", 1), ("x", "E1", 2), ("x", "E3", 8)], "scenario string, event_id string, session int")
    totals = spark.createDataFrame([("x", 4, 20)], "scenario string, sessions int, turns int")
    got = rows_of(b.plan_violations(scripts, stages, events, totals), "rule", "row_key")
    assert got == sorted([("turn_total_differs", "20"), ("session_without_stage", "9"), ("event_of_unknown_session", "E3"), ("too_few_events", "1"), ("too_few_events", "3"), ("too_few_events", "9"), ("too_few_turns", "3"), ("event_id_twice", "E1")])


def test_times_terms_and_padding(spark):
    df = spark.createDataFrame([(2, 3, " "), (2, 3, "given")], "s int, p int, g string")
    made = df.select(b.turn_time(b.session_start(F.col("s")), F.col("p"), F.col("g")).alias("t"))
    assert [r.t for r in made.collect()] == ["2024-03-17T10:03:45", "given"]
    terms = spark.createDataFrame([(["Humor", "Sad", "self minimization", " sad "],)], "t array<string>").select(b.without_non_emotions(F.col("t")).alias("t"))
    assert terms.first().t == ["Sad", "sad"]
    raw = spark.createDataFrame([("x", 1, "a"), ("x", 5, "b")], "scenario string, no int, v string")
    wanted = spark.createDataFrame([("x", 2)], "scenario string, wanted int")
    assert rows_of(b.padded(raw, wanted), "no", "v") == [(1, "a"), (2, None)]
    sides = spark.createDataFrame([("",), ("Teacher",), ("mia",), ("Sam",), ("Guest",), (None,)], "v string").select(canonical_speaker(F.col("v"), F.lit("Sam"), F.lit("Mia")).alias("v"))
    assert [r.v for r in sides.collect()] == ["Sam", "Sam", "Mia", "Sam", "Guest", None]
