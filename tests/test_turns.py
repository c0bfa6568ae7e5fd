import json
from datetime import datetime

import pytest
from conftest import rows_of

from dialoom.operators import quality, turns, units
from dialoom.operators import questions as q

CONV = "conversation_id string, dia_id string, speaker string, spoken_at string, turn_index_global int, text string, voice_style string, audio_id string, modality_available array<string>, is_deleted boolean, ingested_at timestamp_ntz"


@pytest.fixture(scope="module")
def placed(spark):
    rows = [("c", f"D{s}:{n}", "A" if n % 2 else "B", "t", i, f"text {i}", "steady" if i != 2 else None, None, ["text"], False, datetime(2024, 1, s)) for i, (s, n) in enumerate([(1, 1), (1, 2), (2, 1), (2, 2), (10, 1)], 1)]
    rows.append(("c", "d1-2", "B", "t", 2, "newer", "x", None, ["text"], False, datetime(2024, 2, 1)))
    rows.append(("c", "D10:1", "B", "t", 5, "gone", "x", None, ["text"], True, datetime(2024, 2, 1)))
    return turns.ordered(turns.latest(spark.createDataFrame(rows, CONV))).cache()


def test_latest_and_order(placed):
    assert rows_of(placed, "history_pos", "dia_id", "text") == [(1, "D1:1", "text 1"), (2, "D1:2", "newer"), (3, "D2:1", "text 3"), (4, "D2:2", "text 4")]


def test_windows(placed):
    assert rows_of(turns.tumbling_windows(placed), "session", "window_no", "dia_ids") == [(1, 0, "D1:1 D1:2"), (2, 0, "D2:1 D2:2")]
    assert rows_of(turns.sliding_windows(placed), "center_pos", "n_turns") == [(1, 3), (2, 4), (3, 4), (4, 3)]


def test_context_spans(spark, placed):
    anchors = spark.createDataFrame([(1, "c", 2, 2), (2, "c", 9, 9)], "qa_key int, conversation_id string, session long, turn long")
    got = turns.context_spans(anchors, placed).collect()
    assert [(r.qa_key, r.n_full, r.n_local, r.n_prior, r.n_windows) for r in got] == [(1, 4, 2, 3, 2)]


def test_gaps_and_filling(spark, placed):
    from pyspark.sql import functions as F

    holes = placed.withColumn("turn_index", F.when(F.col("history_pos") == 2, 7).when(F.col("history_pos") == 3, None).otherwise(F.col("turn_index")))
    assert rows_of(turns.index_gaps(holes), "dia_id") == [("D1:2",), ("D2:1",), ("D2:2",)]
    assert rows_of(turns.filled_index(holes), "dia_id", "filled_index") == [("D1:1", 1), ("D1:2", 7), ("D2:1", 8), ("D2:2", 4)]


def test_flattened_documents(spark):
    turn = lambda i, **k: {"dia_id": i, "speaker": "A", "text": i or "none"} | k
    doc = {"conversation_id": "c", "session_2": [turn("D2:1")], "session_2_date_time": "x", "session_10": [turn("D10:1"), turn("D10:1", text="last"), turn(None)], "other": "y"}
    got = turns.flattened(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert rows_of(got, "session", "dia_id", "text", "session_date_time") == [(10, "D10:1", "last", None), (10, None, "none", None), (2, "D2:1", "D2:1", "x")]


QA = "qa_key long, conversation_id string, question_id string, anchor_dia_id string, question_text string, gold_answer string, gold_rationale string, question_type string, content_type string, reasoning_structure string, memory_level string, modality_condition string, adversarial_flag boolean, adversarial_type string, answer_options array<string>, acceptable_answers array<string>, critical_event_ids array<string>, evidence_turn_ids array<string>, key_explanation_points array<string>, ingested_at timestamp_ntz"


def question(key, anchor, evidence, **over):
    base = dict(qa_key=key, conversation_id="c", question_id=f"Q{key}", anchor_dia_id=anchor, question_text=f"why {key}", gold_answer="x", gold_rationale=None, question_type="judgment", content_type="long_term_fact",
                reasoning_structure="multi-hop", memory_level="Level 3", modality_condition=None, adversarial_flag=None, adversarial_type=None, answer_options=["a", "b"], acceptable_answers=None,
                critical_event_ids=None, evidence_turn_ids=evidence, key_explanation_points=None, ingested_at=datetime(2024, 1, 1))
    return tuple((base | over).values())


@pytest.fixture(scope="module")
def features(spark, placed):
    rows = [
        question(1, "D2:2", ["D1:2", "D2:2"]), question(2, "D2:2", ["D2:2"], question_type="Modality Missing", question_text="if it was described as calm"),
        question(3, "D9:9", ["D1:1"]), question(4, "D1:1", ["D2:2"], question_text="in Session 2 or D3:10", question_type="retrieval"), question(5, None, None, memory_level="bad"),
        question(6, "D2:2", ["D1:1", "D1:2", "D2:1"], adversarial_flag=True), question(7, "D2:2", [], question_text="Why  1"),
    ]
    return q.features(q.normalized(q.latest(spark.createDataFrame(rows, QA))), placed).cache()


def test_memory_levels(features):
    assert dict(rows_of(features, "qa_key", "inferred_level")) == {1: "Level 2", 2: "Level 0", 3: "Level 3", 4: "Level 0", 5: "Level 0", 6: "Level 3", 7: "Level 0"}


def test_question_rules(features):
    got = set(rows_of(quality.question_violations(features), "row_key", "rule"))
    assert {("3", "anchor_missing"), ("4", "future_evidence"), ("4", "names_session_or_turn"), ("2", "replacement_cue"), ("6", "adversarial_type_missing"), ("7", "no_evidence"), ("2", "level3_without_prior")} <= got
    assert not any(k == "1" for k, _ in got)
    with pytest.raises(ValueError):
        quality.assert_valid(quality.question_violations(features))


def test_scores_and_curation(features):
    s = q.scored(features)
    by = {r.qa_key: r for r in s.collect()}
    assert by[1].hard_score == 3 - 6 + 1 and by[1].final_score == 6 - 8 + 3 + 2 + 1
    assert [r.qa_key for r in q.repeated_wording(features).collect()] == [7]
    picked = {r.qa_key for r in q.curated(s, 3).collect()}
    assert len(picked) == 3 and len({2, 6, 7, 1} & {r.qa_key for r in q.one_per_anchor(s).collect()}) == 1
    kept = dict(rows_of(q.kept_or_demoted(s, 2), "qa_key", "kept"))
    assert sum(kept.values()) >= 2


def test_masking(features, placed):
    got = {(r.qa_key, r.dia_id): r.masked_voice for r in units.session_views(features.drop("session", "turn", "anchor_id", "anchor_text", "anchor_index", "anchor_pos", "anchor_session_pos", "sessions_before"), placed).collect()}
    assert got[(2, "D2:2")] == "unavailable" and got[(2, "D2:1")] == "unavailable" and got[(1, "D2:2")] is None


def test_contexts_are_written_where_they_arise(spark, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", 7)
    monkeypatch.setattr(turns, "PART_ANCHORS", 4)
    place = lambda c, i: (c, i // 3, i % 3 + 1, i % 3 + 1, i, f"D{i // 3}:{i % 3 + 1}")
    placed = spark.createDataFrame([place(c, i) for c, n in (("a", 40), ("b", 3), ("c", 5)) for i in range(1, n + 1)], "conversation_id string, session long, turn int, session_pos long, history_pos long, dia_id string")
    anchors = spark.createDataFrame([(i, "a", 1 + i * 5 % 40, f"f{i}") for i in range(30)] + [(90, "b", 1, "x"), (91, "b", 3, None)], "qa_key long, conversation_id string, history_pos long, fact string")
    rows = turns.prefix_rows(anchors, placed, "qa_key", "fact")
    asked = anchors.collect()
    assert rows_of(rows, "qa_key", "history_pos", "fact") == sorted(((a[0], i, a[3]) for a in asked for i in range(1, a[2] + 1)), key=repr)
    # the join that makes the context rows is the last one, and nothing is shuffled after it
    top = rows._jdf.queryExecution().executedPlan().toString().split("Join")[:2]
    assert "Exchange" not in top[0] and "__block" in top[1].split("\n")[0]


def test_candidates_are_written_where_they_arise(spark):
    placed = spark.createDataFrame([("a", i // 3, i % 3 + 1, i % 3 + 1, i, f"D{i // 3}:{i % 3 + 1}") for i in range(1, 41)], "conversation_id string, session long, turn int, session_pos long, history_pos long, dia_id string")
    asked = spark.createDataFrame([(i, "a", 1 + i * 5 % 40) for i in range(30)], "qa_key long, conversation_id string, history_pos long")
    rows = turns.retrieval_candidates(asked, placed, "qa_key")
    assert rows_of(rows, "qa_key", "history_pos") == sorted(((a[0], i) for a in asked.collect() for i in range(1, a[2])), key=repr)
    top = rows._jdf.queryExecution().executedPlan().toString().split("Join")[:2]
    assert "Exchange" not in top[0] and "__block" in top[1].split("\n")[0]


def test_files_of_contexts_keep_recurring_anchors_as_repeats(spark, tmp_path):
    n = 400
    placed = spark.range(1, n + 1).selectExpr("'a' as conversation_id", "id div 9 as session", "int(id % 9 + 1) as turn", "id % 9 + 1 as session_pos", "id as history_pos", "concat('D', id div 9, ':', id % 9 + 1) as dia_id")
    asked = spark.range(3001).selectExpr("id * 7919 as qa_key", "'a' as conversation_id", f"bigint({n} - id % 5) as history_pos")
    rows = turns.retrieval_candidates(asked, placed, "qa_key").select("qa_key", "session", "window_no", "item_no", "dia_id")
    rows.write.parquet(str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).distinct().count() == sum(n - i % 5 - 1 for i in range(3001))
    assert sum(p.stat().st_size for p in (tmp_path / "rows").glob("*.parquet")) < 3001 * n / 2


def test_whole_units_cut_contexts_from_packed_turns(features, placed, spark):
    asked = features.select("qa_key", "conversation_id", "question_id").distinct()
    plain = features.select(*[c.split()[0] for c in QA.split(", ") if c.split()[0] != "ingested_at"])
    notes = spark.createDataFrame([], "conversation_id string, dia_id string, underlying_emotion string, relation_state string, memory_dependency_level string")
    built = units.units(plain, notes, placed, whole=True)
    full = built.selectExpr("qa_key", "explode(full_history_context) as x").selectExpr("qa_key", "x.history_pos as pos", "x.dia_id as dia_id", "x.masked_voice as voice")
    views = units.history_views(plain, placed).selectExpr("qa_key", "history_pos as pos", "dia_id", "masked_voice as voice")
    assert rows_of(full, "qa_key", "pos", "dia_id", "voice") == rows_of(views, "qa_key", "pos", "dia_id", "voice") and asked.count()
    items = built.selectExpr("qa_key", "posexplode_outer(retrieval_candidates) as (no, w)").selectExpr("qa_key", "no", "explode(w) as x").selectExpr("qa_key", "no", "x.item_no as item", "x.dia_id as dia_id")
    kept = units.candidates(plain, placed).selectExpr("qa_key", "dense_rank() over (partition by qa_key order by session, window_no) - 1 as no", "item_no as item", "dia_id")
    assert rows_of(items, "qa_key", "no", "item", "dia_id") == rows_of(kept, "qa_key", "no", "item", "dia_id")
    # only the joins that lead to the packed turns are shuffled, no context row is
    top = built._jdf.queryExecution().executedPlan().toString().split("Join")[:2]
    assert "Exchange" not in top[0] and "__part" in top[1].split("\n")[0]


def test_tiles_of_contexts_are_spread_whatever_their_bytes(spark):
    placed = spark.range(1, 2001).selectExpr("'a' as conversation_id", "id div 9 as session", "int(id % 9 + 1) as turn", "id % 9 + 1 as session_pos", "id as history_pos", "concat('D', id) as dia_id")
    asked = spark.range(1, 2001).selectExpr("id as qa_key", "'a' as conversation_id", "id as history_pos")
    rows = turns.prefix_rows(asked, placed, "qa_key")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and rows.count() == 2000 * 2001 // 2
