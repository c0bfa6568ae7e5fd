from datetime import datetime

from conftest import rows_of
from pyspark.sql import functions as F

from dialoom.functions.ids import is_blank, turn_numbers
from dialoom.operators.references import orphan_references, orphan_report

QA = "qa_key bigint, conversation_id string, anchor_dia_id string, evidence_turn_ids array<string>, created_at timestamp_ntz, ingested_at timestamp_ntz, period string, state string"
CONV = "conversation_id string, dia_id string, is_deleted boolean, ingested_at timestamp_ntz, used string"


def day(n):
    return datetime(2024, 1, n)


def test_ways_to_write_an_id(spark):
    texts = ["D1:2", "d1:2", " D1 : 2 ", "D1：2", "D1-2", "​D1:2", "D01:002", "１:2", "D1:2x", "D1", "D:2", "turn 2", "", None, "D1:2:3", "D12345678901234567890:1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(turn_numbers(F.col("t")).alias("n"), is_blank(F.col("t")).alias("blank"))
    got = [((r.n.session, r.n.turn) if r.n else None, r.blank) for r in df.collect()]
    assert [n for n, _ in got[:8]] == [(1, 2)] * 8
    assert all(n is None for n, _ in got[8:])
    assert [b for _, b in got] == [False] * 12 + [True, True, False, False]


def test_states(spark):
    conv = spark.createDataFrame([
        ("c", "D1:1", None, day(1), ""), ("c", "D1:2", True, day(1), ""), ("c", "d1-3", True, day(1), ""), ("c", "D1:3", False, day(9), ""),
        ("c", "D1:4", False, None, ""), (None, "D1:1", False, day(1), ""), ("c", "D1:1", False, day(20), ""),
    ], CONV)
    qa = spark.createDataFrame([
        (1, "c", "D1:1", ["D1:2", None, " ", "D1:3", "D9:9"], day(2), day(5), "", ""), (2, "c", "D1:3", None, day(2), day(10), "", ""),
        (3, None, "D1:1", [], day(2), day(5), "", ""), (4, "c", "D?:?", ["D1:4", "D1:4"], None, None, "", ""), (5, "x", None, ["D1:1"], day(2), day(5), "", ""),
    ], QA)
    got = orphan_references(qa, conv)
    assert rows_of(got, "qa_key", "ref_field", "ref_pos", "state") == sorted([
        (1, "evidence_turn_ids", 1, "deleted"), (1, "evidence_turn_ids", 4, "late"), (1, "evidence_turn_ids", 5, "missing"), (3, "anchor_dia_id", 0, "missing"),
        (4, "anchor_dia_id", 0, "missing"), (5, "evidence_turn_ids", 1, "missing"),
    ], key=repr)
    assert sum(r.n_references for r in orphan_report(got).collect()) == 6


def test_empty_tables(spark):
    assert orphan_references(spark.createDataFrame([], QA), spark.createDataFrame([], CONV)).count() == 0
    qa = spark.createDataFrame([(1, "c", "D1:1", None, day(2), day(5), "", "")], QA)
    assert rows_of(orphan_references(qa, spark.createDataFrame([], CONV)), "qa_key", "state") == [(1, "missing")]


def test_a_hot_key_keeps_all_its_rows(spark):
    conv = spark.createDataFrame([("c", "D1:1", True, day(1), "")], CONV)
    qa = spark.range(3000).select(
        F.col("id").alias("qa_key"), F.lit("c").alias("conversation_id"), F.lit("D1:1").alias("anchor_dia_id"), F.array(F.lit("D1:1")).alias("evidence_turn_ids"),
        F.lit(day(2)).cast("timestamp_ntz").alias("created_at"), F.lit(day(3)).cast("timestamp_ntz").alias("ingested_at"),
    )
    assert orphan_references(qa, conv).groupBy("state").count().collect()[0]["count"] == 6000
