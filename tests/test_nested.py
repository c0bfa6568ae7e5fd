import json

from conftest import rows_of

from dialoom.operators import nested

T = {"speaker": "A", "text": "x"}
SCHEMA = "unit_key bigint, task_layer string, benchmark_views string, history_evidence array<struct<dia_id:string>>, value string, kind string"


def unit(key, task, views, history=None):
    dump = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return key, dump(task), dump(views), history, "", ""


def test_members_in_all_layouts(spark):
    rows = [
        unit(1, {"options": ["a", None, "b"]}, {"session_local_context": [T, None, T], "full_history_context": T, "retrieval_candidates": [[T, None], T, None, json.dumps([T])]}, [("D1:1",), None]),
        unit(2, json.dumps(json.dumps({"options": json.dumps(["a"])})), {"modality_conditioned_views": {"some_key": {"session_local_context": json.dumps([T]), "full_history_context": [None]}, "n": None}}),
        unit(3, "{broken", "", []),
        unit(4, None, "null", None),
        unit(5, {"options": {"label": "A"}}, {"retrieval_candidates": T, "modality_conditioned_views": {"a.b": {"session_local_context": [T], "deep": {"session_local_context": [T]}}}}),
    ]
    got = rows_of(nested.member_elements(spark.createDataFrame(rows, SCHEMA)), "unit_key", "member_path", "group_no", "item_no")
    b = "benchmark_views."
    assert got == sorted([
        (1, "task_layer.options", 0, 0), (1, "task_layer.options", 0, 2), (1, b + "session_local_context", 0, 0), (1, b + "session_local_context", 0, 2),
        (1, b + "full_history_context", 0, 0), (1, b + "retrieval_candidates", 0, 0), (1, b + "retrieval_candidates", 1, 0), (1, b + "retrieval_candidates", 3, 0),
        (1, "history_evidence", 0, 0), (2, "task_layer.options", 0, 0), (2, b + "modality_conditioned_views.some_key.session_local_context", 0, 0),
        (5, "task_layer.options", 0, 0), (5, b + "retrieval_candidates", 0, 0), (5, b + "modality_conditioned_views.a.b.session_local_context", 0, 0),
    ], key=repr)


def test_one_flat_table_of_turns(spark):
    rows = [unit(1, None, {"session_local_context": [T, {"speaker": None, "text": 5}], "retrieval_candidates": [[T], {"text": "lone"}]}), unit(2, None, json.dumps({"full_history_context": json.dumps([json.dumps(T)])}))]
    got = rows_of(nested.flat_table(spark.createDataFrame(rows, SCHEMA), ["benchmark_views"], ["speaker", "text"]), "unit_key", "member_path", "group_no", "item_no", "speaker", "text")
    b = "benchmark_views."
    assert got == sorted([(1, b + "session_local_context", 0, 0, "A", "x"), (1, b + "session_local_context", 0, 1, None, "5"), (1, b + "retrieval_candidates", 0, 0, "A", "x"),
                          (1, b + "retrieval_candidates", 1, 0, None, "lone"), (2, b + "full_history_context", 0, 0, "A", "x")], key=repr)


def test_parents_by_truncation(spark):
    df = nested.dewey_nodes(spark.createDataFrame([unit(1, {"a": {"b": [1, None, {"c": "x" * 50000}]}, "d": True}, None)], SCHEMA))
    nodes = {r.dewey: r for r in df.collect()}
    assert nodes["0.0.2.0"].schema_path == "task_layer.a.b[].c" and len(nodes["0.0.2.0"].value) == 50000
    assert all(r.parent_dewey in nodes or r.parent_dewey == "" for r in nodes.values())
    assert "0.0.1" not in nodes and nodes["1"].kind == "boolean"
    assert {r.schema_path for r in nested.path_tables(df).collect()} == {r.schema_path for r in nodes.values()}


def test_typed_columns_have_nodes(spark):
    schema = SCHEMA.replace("struct<dia_id:string>", "struct<dia_id:string,speaker:string,modality_available:array<string>>")
    df = nested.dewey_nodes(spark.createDataFrame([unit(1, None, None, [("D1:1", None, ["text", "audio"]), None, ("D1:2", "B", None)])], schema))
    assert rows_of(df, "dewey", "parent_dewey", "schema_path", "value") == sorted([
        ("0", "", "history_evidence[]", None), ("0.0", "0", "history_evidence[].dia_id", "D1:1"), ("0.2", "0", "history_evidence[].modality_available", None),
        ("0.2.0", "0.2", "history_evidence[].modality_available[]", "text"), ("0.2.1", "0.2", "history_evidence[].modality_available[]", "audio"),
        ("2", "", "history_evidence[]", None), ("2.0", "2", "history_evidence[].dia_id", "D1:2"), ("2.1", "2", "history_evidence[].speaker", "B"),
    ], key=repr)


def test_nothing_to_label(spark):
    assert nested.member_elements(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nested.readable("[" * 100_000) is None
