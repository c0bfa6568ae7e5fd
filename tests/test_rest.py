import json
import random

from conftest import rows_of
from pyspark.sql import functions as F

from dialoom.operators import analytics, model_calls, planning, retrieval
from dialoom.sources import files
from dialoom.streaming import ingest


def test_quotas():
    assert planning.brought_to(7, {"a": 1, "b": 1}, ["a", "b"]) == {"a": 4, "b": 3}
    assert planning.brought_to(2, {"a": 3, "b": 2}, ["a", "b"]) == {"a": 2, "b": 0}
    assert planning.brought_to(0, {"a": 0}, []) == {"a": 0}
    assert planning.remaining(4, {"a": 3, "b": 3}, {"a": 3}) == {"a": 1, "b": 3}
    assert planning.scaled(5, 0.5) == 2 and planning.phases(24) == (12, 12)
    plan = planning.jittered(50, {"a": 0.5, "b": 0.3, "c": 0.2}, 0.1, random.Random("s"))
    assert sum(plan.values()) == 50 and plan == planning.jittered(50, {"a": 0.5, "b": 0.3, "c": 0.2}, 0.1, random.Random("s"))


def test_bm25_and_cosine(spark):
    queries = spark.createDataFrame([(1, "x", "red lamp red"), (2, "x", ""), (3, "y", "lamp")], "query_id int, corpus string, text string")
    docs = spark.createDataFrame([("x", 1, "red lamp"), ("x", 2, "blue"), ("x", 3, None), ("y", 1, "lamp")], "corpus string, doc int, text string")
    got = {(r.query_id, r.doc): r for r in retrieval.hybrid(queries, docs).collect()}
    assert got[(1, 1)].bm25 > 0 == got[(1, 2)].bm25 == got[(2, 1)].bm25 and got[(1, 3)].cosine == 0
    assert abs(got[(3, 1)].cosine - 1) < 1e-9 and got[(1, 1)].score == 1.0 and got[(2, 1)].score == 0.0
    assert [r.doc for r in retrieval.top(retrieval.hybrid(queries, docs), 1, "doc").where("query_id = 2").collect()] == [1]


def test_analytics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("", 2.0), (None, 4.0)], "g string, v double")
    assert rows_of(analytics.group_mean(rows, "g", "v"), "group", "count", "mean") == [("a", 2, 1.0), ("unknown", 2, 3.0)]
    scores = spark.createDataFrame([("i", "r1", 1.0), ("i", "r2", 0.9), ("j", "r1", 1.0), ("k", "r1", None)], "item string, run string, score double")
    crossed = analytics.cross_run(scores, 0.9)
    assert rows_of(crossed, "item", "all_above", "n_missing") == [("i", True, 0), ("j", False, 1)]
    assert analytics.share_above(crossed, 3).first().easy_pct == 33.3
    low = spark.createDataFrame([("b", None), ("a", 0.5), ("c", 0.1)], "q string, s double")
    assert [r.q for r in analytics.bottom(low, "s", "q", 3).collect()] == ["c", "a", "b"]
    units = spark.createDataFrame([("u1",), ("u2",), ("u3",)], "u string")
    assert rows_of(analytics.retry(units, units.where("u <> 'u3'"), units.where("u = 'u2'"), "u"), "u") == [("u2",), ("u3",)]


def test_report_scan_and_bundle(spark, tmp_path):
    report = "head\n1. Item 1:\n {'unit_id': 'U_1'}\nActual: {'answer': 'error'}\n Scores: x\n2. Item 2:\n {'unit_id': 'U_2'}\n"
    got = files.report_items(spark.createDataFrame([("r", report)], "report string, value string"))
    assert rows_of(got, "item_no", "unit_id", "answer") == [(0, "U_1", "{'answer': 'error'}"), (1, "U_2", None)]
    for i in (1, 2):
        (tmp_path / f"scenario_00{i}").mkdir()
        (tmp_path / f"scenario_00{i}" / "personas.json").write_text(json.dumps({"n": i}))
    (tmp_path / "scenario_001" / "events.json").write_text("[]")
    got = files.bundle(spark, str(tmp_path), ["personas", "events"])
    assert rows_of(got, "scenario", "events") == [("scenario_001", "[]"), ("scenario_002", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä", {"m": 0.5}), (2, None, {})], "k int, v string, s map<string,double>")
    files.write_csv(df, str(tmp_path / "csv"), "s", ("m",))
    body = next((tmp_path / "csv").glob("*.csv")).read_text("utf-8")
    assert body.startswith("﻿k,v,m")
    files.write_missing(df.select("k", "v"), str(tmp_path / "t"), "k")
    files.write_missing(spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string"), str(tmp_path / "t"), "k")
    assert rows_of(spark.read.parquet(str(tmp_path / "t")), "k", "v") == [(1, "ä"), (2, None), (3, "y")]
    files.quarantine(df.select("k", "v"), "v is null", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    assert "| 1 | ä |" in files.markdown("t", df.select("k", "v"))


def test_model_calls_skip_and_retry(spark):
    prompts = spark.createDataFrame([("a", "xx"), ("b", "y")], "key string, prompt string")
    got = model_calls.answers(prompts, model_calls.stub, done=prompts.where("key = 'b'"))
    assert rows_of(got, "key", "answer") == [("a", '{"answer": "2 characters"}')]
    waits, tries = [], iter([1, 1, 0])

    def flaky(prompt):
        if next(tries):
            raise model_calls.Retryable("busy")
        return "ok"

    assert model_calls.call(flaky, "p", sleep=waits.append) == ("ok", None) and waits == [30.0, 60.0]


def test_stream_appends_only_new_keys(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "conversation_id string, dia_id string, speaker string, ingested_at timestamp_ntz, k string"
    batch = spark.sql("select 'c' as conversation_id, 'D1:1' as dia_id, 'A' as speaker, timestamp_ntz'2024-01-01 10:00:00' as ingested_at, '1' as k")
    for i in range(2):
        batch.withColumn("speaker", F.lit(str(i))).write.mode("append").parquet(src)
        stream = ingest.turn_stream(spark, src, schema)
        ingest.append_new(stream, out, "k", str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(out).count() == 1
    counted = ingest.hourly_counts(ingest.deduplicated(ingest.turn_stream(spark, src, schema)))
    assert counted.isStreaming
