"""Deeply nested records as flat node tables by Dewey labels.

Every node of a nested value gets the path of ordinals that leads to it (``2.0.14``). The parent of
a node is its label without the last ordinal, so no link table is built and no join is needed to
walk up; nodes of one schema path form one flat table. Labelling is a narrow map over the rows:
nothing is shuffled, and each row's tree is held alone in memory.

Defined cases: JSON held as a string counts as what it encodes (at any depth, when it encodes an
object or an array); a lone object where an array is wanted is its item 0; null elements get no
node, yet keep their ordinal; null, blank and unreadable column text gives no node; repeated
exports are separate rows with their own key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "unit_key bigint, member string, dewey string, schema_path string, depth int, kind string, value string"

#: Schema paths (patterns) of members that hold arrays, how many array levels they have, and the depth at which they stand.
ARRAY_MEMBERS = [
    ("history_evidence", 1, 0), ("task_layer.options", 1, 1), ("benchmark_views.session_local_context", 1, 1), ("benchmark_views.full_history_context", 1, 1), ("benchmark_views.retrieval_candidates", 2, 1),
    ("benchmark_views.modality_conditioned_views.%.session_local_context", 1, 3), ("benchmark_views.modality_conditioned_views.%.full_history_context", 1, 3),
]


#: Ends of the paths of these arrays, for their scalar items.
ITEMS = tuple(f".{pattern.rsplit('.', 1)[-1]}{'[]' * n}" for pattern, levels, _ in ARRAY_MEMBERS for n in range(levels))


def decoded(value: object) -> object:
    """What a value stands for: a string that encodes an object or array counts as that."""
    while isinstance(value, str):
        text = value.strip().lstrip("﻿").strip()
        if text[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = json.loads(text)
        except (ValueError, RecursionError):
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def readable(text: str | None) -> object:
    """The value of a whole column text, None if it cannot be read."""
    if text is None:
        return None
    try:
        return decoded(json.loads(text.strip().lstrip("﻿")))
    except (ValueError, RecursionError):
        return None


_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean"}
_MAY_ENCODE = frozenset('{["\ufeff \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000')


def label_nodes(key: int, column: str, value: object, scalars_of: tuple[str, ...] | None = None) -> Iterator[tuple]:
    """All nodes below a column's value, depth first; ordinals count keys in their order and items from 0.

    With ``scalars_of`` scalars get a node only as items of arrays whose path ends so; all others keep their labels.
    """
    stack = [(decoded(value), "", column, 0)]
    while stack:
        node, label, path, depth = stack.pop()
        kind = type(node)
        if label:
            scalar = None if kind is dict or kind is list else node if kind is str else json.dumps(node)
            yield key, column, label, path, depth, _KINDS.get(kind, "number"), scalar
        if kind is dict:
            steps, scalars = list(node.items()), scalars_of is None
        elif kind is list:
            steps, scalars = [(None, v) for v in node], scalars_of is None or path.endswith(scalars_of)
        else:
            continue
        below = f"{path}[]"
        front = f"{label}." if label else ""
        for i in range(len(steps) - 1, -1, -1):
            name, v = steps[i]
            if v is None:
                continue
            if type(v) is str and v[:1] in _MAY_ENCODE:
                v = decoded(v)
            if scalars or type(v) is dict or type(v) is list:
                stack.append((v, f"{front}{i}", below if name is None else f"{path}.{name}", depth + 1))


def _labelled(df: DataFrame, columns: list[str], scalars_of: tuple[str, ...] | None) -> DataFrame:
    names = ["unit_key", "member", "dewey", "schema_path", "depth", "kind", "value"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for column, texts in zip(columns, batch.columns[1:]):
                for key, text in zip(keys, texts):
                    value = readable(text.as_py())
                    if value is None:
                        continue
                    rows.extend(label_nodes(key, column, value, scalars_of))
                    if len(rows) > 50_000:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return df.select("unit_key", *columns).mapInArrow(run, NODE_SCHEMA)


def parent(label: Column) -> Column:
    """Label of the node above: the label without its last ordinal."""
    return F.substring(label, F.lit(1), F.length(label) - F.length(F.substring_index(label, ".", -1)) - 1)


def last_ordinal(label: Column) -> Column:
    return F.substring_index(label, ".", -1).try_cast("int")


def dewey_nodes(units: DataFrame, columns: list[str] = ["task_layer", "benchmark_views", "history_evidence"], scalars_of: tuple[str, ...] | None = None) -> DataFrame:  # noqa: B006
    """All nodes of the nested columns, with parent labels by truncation; typed columns count as their JSON, nulls kept for the ordinals."""
    kinds = dict(units.dtypes)
    texts = [F.col(c) if kinds[c] == "string" else F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in columns]
    nodes = _labelled(units.select("unit_key", *texts), columns, scalars_of)
    return nodes.withColumn("parent_dewey", parent(F.col("dewey")))


def typed_array_nodes(units: DataFrame, column: str) -> DataFrame:
    """Nodes of a typed array column, labelled without leaving the JVM."""
    return units.select("unit_key", F.posexplode(column).alias("i", "v")).where("v is not null").select(
        "unit_key", F.lit(column).alias("member"), F.col("i").cast("string").alias("dewey"),
        F.lit(column).alias("schema_path"), F.lit(1).alias("depth"), F.lit("object").alias("kind"),
        F.to_json("v").alias("value"),
    )


def member_elements(units: DataFrame) -> DataFrame:
    """(unit_key, member_path, group_no, item_no, dewey): one row per element of the array members.

    All nodes but scalars elsewhere are labelled; the elements are the nodes of the schema paths of the
    wanted tables. An element's place is its last ordinal, its window's the last ordinal of its parent
    label. A lone object at such a path is its own element 0.
    """
    nodes = dewey_nodes(units, ["task_layer", "benchmark_views"], ITEMS).select("unit_key", "schema_path", "dewey", "parent_dewey", "depth", "kind")
    typed = typed_array_nodes(units, "history_evidence").select("unit_key", F.lit("history_evidence[]").alias("schema_path"), "dewey", F.lit("").alias("parent_dewey"), "depth", "kind")
    nodes = nodes.unionByName(typed)
    member = F.rtrim("schema_path", F.lit("[]"))
    levels = F.shiftright(F.length("schema_path") - F.length(member), 1)
    wanted = F.coalesce(*[F.when(F.like(member, F.lit(pattern)) & (F.col("depth") - levels == depth), n) for pattern, n, depth in ARRAY_MEMBERS])
    placed = nodes.select("unit_key", member.alias("member_path"), wanted.alias("__n"), levels.alias("__levels"), "dewey", "parent_dewey", "kind").where("__n is not null")
    missing = F.col("__n") - F.col("__levels")  # array levels that a lone object stands for
    ordinals = F.array(last_ordinal(F.col("parent_dewey")), last_ordinal(F.col("dewey")))
    own = F.when(missing == 0, ordinals[1]).otherwise(0)
    group = F.when(F.col("__n") == 1, 0).when(missing == 0, ordinals[0]).when(missing == 1, ordinals[1]).otherwise(0)
    return placed.where((missing == 0) | ((missing > 0) & (F.col("kind") == "object"))).select("unit_key", "member_path", group.cast("int").alias("group_no"), own.cast("int").alias("item_no"), "dewey")


def flat_table(units: DataFrame, columns: list[str], members: list[str]) -> DataFrame:
    """The elements of the array members as one flat table, a column for each wanted scalar member.

    Elements and their scalars meet by (unit, label of the element): the label of a scalar without its
    last ordinal. Columns unit_key, member_path, group_no, item_no and the members.
    """
    elements = member_elements(units).where("member_path like 'benchmark_views.%'")
    scalars = dewey_nodes(units, columns).where(~F.col("kind").isin("object", "array"))
    name = F.regexp_extract("schema_path", r"\.([^.\[\]]+)$", 1)
    wide = scalars.where(name.isin(*members)).groupBy("unit_key", F.col("parent_dewey").alias("dewey")).agg(*[F.max(F.when(name == m, F.col("value"))).alias(m) for m in members])
    return elements.join(wide, ["unit_key", "dewey"], "left").drop("dewey")


def path_tables(nodes: DataFrame) -> DataFrame:
    """Size of each flat table, one per schema path."""
    return nodes.groupBy("schema_path").agg(
        F.count("*").alias("n_nodes"), F.countDistinct("unit_key").alias("n_units"), F.max("depth").alias("depth")
    )
