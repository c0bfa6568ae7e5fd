import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from dialoom.operators import generation, items, repair, runs
from dialoom.sources import files, remote


def test_remote_pages_and_scores(spark):
    got = remote.remote_items(spark, "dialoom.sources.remote:stub", "id bigint, name string, absent string")
    assert rows_of(got, "id", "name", "absent") == [(10, "n0", None), (20, "n0", None), (21, "n1", None)]

    def fetch(trace):
        if trace == "bad":
            raise OSError("down")
        return [("a", 1), ("b", None)]

    traces = spark.createDataFrame([("t",), ("bad",), ("t",)], "trace string")
    assert rows_of(remote.fetched_scores(traces, fetch), "trace", "metric", "value", "error") == sorted([("t", "a", "1", None), ("t", "b", None, None), ("bad", None, None, "down")], key=repr)
    assert rows_of(runs.last_scores(remote.fetched_scores(traces, fetch)), "trace", "scores") == [("t", {"a": 1.0})]


def test_settings(tmp_path):
    (tmp_path / "p.json").write_text('{"profiles": {"x": {"model": "m"}}}')
    assert remote.profiles(str(tmp_path / "p.json")) == {"x": {"model": "m"}} and remote.profiles(str(tmp_path / "none.json")) == {}
    assert remote.first_setting({"A": "", "B": "b"}, "A", "B") == "b" and remote.first_setting({}, "A") is None
    with pytest.raises(KeyError):
        remote.first_setting({}, "A", required=True)
    assert repair.merged_settings({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "d": {"e": 1}}) == {"a": {"b": 5, "c": 2}, "d": {"e": 1}}


def test_files_in_order(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scenarios(spark, str(tmp_path))
    for i in (2, 1):
        (tmp_path / f"scenario_00{i}").mkdir()
        (tmp_path / f"scenario_00{i}" / "all_units.json").write_text(json.dumps([{"u": 10 * i + k} for k in range(3)]))
    assert files.scenarios(spark, str(tmp_path)) == ["scenario_001", "scenario_002"]
    got = files.units(spark, str(tmp_path / "scenario_*/all_units.json"), first=4)
    assert [json.loads(r.value)["u"] for r in got.collect()] == [10, 11, 12, 20]
    assert files.lookup(spark, str(tmp_path / "scenario_001/all_units.json"))[0] == {"u": 10}
    bundles = spark.createDataFrame([("s1", "{}", None), ("s2", "[]", "x")], "scenario string, personas string, events string")
    files.write_bundle(bundles, str(tmp_path / "out"), ["personas", "events"])
    assert rows_of(spark.read.text(str(tmp_path / "out/events")), "value", "scenario") == [("x", "s2")]
    files.write_text(bundles, "scenario", str(tmp_path / "t"))
    assert rows_of(spark.read.text(str(tmp_path / "t")), "value") == [("s1",), ("s2",)]


def test_prompts_rounds_and_dialogues(spark):
    df = spark.createDataFrame([("a", 3, None)], "k string, n int, z string")
    assert df.select(generation.rendered("{{k}}/{{n}}/{{z}}.", k=F.col("k"), n=F.col("n"), z=F.col("z")).alias("p")).first().p == "a/3/."
    assert [r.y for r in spark.createDataFrame([("zh-CN",), ("EN",), (None,)], "x string").select(generation.prompt_language(F.col("x")).alias("y")).collect()] == ["zh", "en", "en"]

    def model(prompt):
        return "good" if "Attempt 2" in prompt or prompt == "easy" else "bad"

    prompts = spark.createDataFrame([("1", "easy"), ("2", "hard")], "key string, prompt string")
    assert rows_of(generation.regenerated(prompts, lambda: model, F.col("answer") == "good"), "key", "answer", "attempt", "valid") == [("1", "good", 1, True), ("2", "good", 2, True)]
    assert rows_of(generation.regenerated(prompts, lambda: lambda p: "bad", F.col("answer") == "good", 2), "key", "attempt", "valid") == [("1", 2, False), ("2", 2, False)]
    generation.checked(lambda: model)
    plans = spark.createDataFrame([("s", 1, 2, "A", "B", "g"), ("s", 2, 3, "A", "B", "g")], "scenario string, session int, turn_count int, first string, second string, goal string")
    said = generation.dialogues(plans, lambda: lambda p: str(p.count("\n")))
    assert rows_of(said, "turn_index_global", "dia_id", "speaker") == [(1, "D1:1", "A"), (2, "D1:2", "B"), (3, "D2:1", "A"), (4, "D2:2", "B"), (5, "D2:3", "A")]


def test_answers_are_evaluated(spark):
    rows = spark.createDataFrame([("1", "q", ["x", "y"], "A) X", "x", ["z"]), ("2", "q", ["x"], "w", "x", None), ("3", "q", None, "free", "gold", None)], "key string, question_text string, answer_options array<string>, said string, gold_answer string, acceptable_answers array<string>")
    judge = lambda: lambda p: '{"final_score": 0.5, "core_answer_correct": 1, "verdict": "ok"}'
    got = {(r.key, r.metric): r.value for r in generation.evaluated(rows, judge).collect()}
    assert got[("1", "exact_match")] == 1.0 and got[("2", "exact_match")] == 0.0 and got[("3", "llm_judge_final")] == 0.5 and len(got) == 8


def test_report_of_a_run(spark, tmp_path):
    schema = "item int, question_id string, question_type string, memory_level string, content_type string, has_options boolean, effective_score double, llm_judge_final double, model_output string, gold_answer string, question_text string, scores map<string,double>"
    rows = spark.createDataFrame([(1, "Q1", "judgment", "Level 1", None, True, 1.0, None, "a", "a", "t?", {"exact_match": 1.0}), (2, "Q2", "explanation", "Level 2", "x", False, None, None, "b" * 300, None, "u?", None)], schema)
    said = runs.report("r", "d", rows)
    assert "- `exact_match`: `1.0`" in said and "| unknown | 1 | 1.0 |" in said and "### Q2 (explanation)" in said and "b" * 237 + "..." in said
    wide = rows.select("question_id", "effective_score")
    files.write_run_table(wide, str(tmp_path / "csv"), ["question_id", "effective_score"])
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbfquestion_id,") for p in (tmp_path / "csv").glob("*.csv"))


def test_lists_and_contexts(spark):
    df = spark.createDataFrame([([" a ", "", None, "A", "b"], ["b", "c"])], "x array<string>, y array<string>")
    row = df.select(repair.strings("x", "none").alias("s"), repair.once_in_any_case(repair.strings("x")).alias("o"), repair.merged(F.col("y"), F.col("x")).alias("m"), repair.without(F.col("x"), F.col("y")).alias("w"),
                    repair.measurable_points(F.array(F.lit("Long_Term_Fact"), F.lit("modality missing"))).alias("p"), repair.strings(F.array(F.lit(" ")), "none").alias("f")).first()
    assert (row.s, row.o, row.m, row.w, row.p, row.f) == (["a", "A", "b"], ["a", "b"], ["b", "c", " a ", "", None, "A"], [" a ", "", None, "A"], ["long-term fact"], ["none"])
    turns = spark.createDataFrame([([("t1", "A", "hi", None), (None, None, None, "low")],)], "t array<struct<spoken_at:string,speaker:string,text:string,voice_style:string>>")
    assert turns.select(items.transcript(F.col("t")).alias("s")).first().s == "[t1] A: hi\n\n[] Unknown: \nvoice_style: low"
    assert turns.select(items.with_evidence(F.lit("h"), F.lit("")).alias("s")).first().s == "h"
