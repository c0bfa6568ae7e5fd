"""Queries of the general data problems (references, nested records) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators import nested, references
from dialoom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_references(table(spark, sf_dir, "qa"), table(spark, sf_dir, "conversation")).drop("period")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(references.orphan_references(table(spark, sf_dir, "qa"), table(spark, sf_dir, "conversation")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.member_elements(table(spark, sf_dir, "all_units")).drop("dewey")


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all contexts as one flat table that leads back to unit and place."""
    return nested.flat_table(table(spark, sf_dir, "all_units"), ["benchmark_views"], ["speaker", "text"])


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.dewey_nodes(table(spark, sf_dir, "all_units"))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and depth of each flat table of nodes, one per schema path."""
    return nested.path_tables(nested.dewey_nodes(table(spark, sf_dir, "all_units")))


def p5_member_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements and units of each member table; member keys of any name count under their own path."""
    return nested.member_elements(table(spark, sf_dir, "all_units")).groupBy("member_path").agg(
        F.count("*").alias("n_elements"), F.countDistinct("unit_key").alias("n_units")
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found, p5_turns, p5_nodes, p5_paths, p5_member_sizes)}

_ID = r"'^[^\p{L}\p{N}]*(?:[DdＤｄ][^\p{L}\p{N}]*)?([0-9]{1,18})[^\p{L}\p{N}]+([0-9]{1,18})[^\p{L}\p{N}]*$'"


def _number(text: str, group: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract(translate({text}, '０１２３４５６７８９', '0123456789'), {_ID}, {group}), '') AS BIGINT)"


_ORPHANS = rf"""
WITH refs AS (
  SELECT qa_key, conversation_id, ingested_at, created_at, 'anchor_dia_id' AS ref_field, 0 AS ref_pos, anchor_dia_id AS v FROM qa
  UNION ALL
  SELECT qa_key, conversation_id, ingested_at, created_at, 'evidence_turn_ids', CAST(i AS INTEGER), evidence_turn_ids[i]
  FROM (SELECT *, unnest(range(1, len(evidence_turn_ids) + 1)) AS i FROM qa)
), c AS (
  SELECT *, {_number("v", 1)} AS s, {_number("v", 2)} AS t FROM refs
  WHERE v IS NOT NULL AND regexp_replace(v, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]', '', 'g') <> ''
), parents AS (
  SELECT conversation_id, s, t, bool_or(live) AS live, min(ingested_at) FILTER (WHERE live) AS since
  FROM (SELECT conversation_id, {_number("dia_id", 1)} AS s, {_number("dia_id", 2)} AS t,
               NOT coalesce(is_deleted, false) AS live, ingested_at FROM conversation)
  WHERE s IS NOT NULL AND conversation_id IS NOT NULL GROUP BY ALL
), found AS (
  SELECT c.qa_key, c.ref_field, c.ref_pos, c.created_at,
         CASE WHEN p.s IS NULL THEN 'missing' WHEN NOT p.live THEN 'deleted' WHEN p.since > c.ingested_at THEN 'late' END AS state
  FROM c LEFT JOIN parents p ON c.conversation_id = p.conversation_id AND c.s = p.s AND c.t = p.t
)
"""

_UNREADABLE = "CASE WHEN {x} IS NOT NULL AND json_valid({x}) THEN json({x}) END"


def _decoded(x: str) -> str:
    for _ in range(2):
        x = f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') AND left(trim({x} ->> '$'), 1) IN ('{{', '[', '\"') THEN json({x} ->> '$') ELSE {x} END)"
    return x


def _as_array(x: str) -> str:
    """A list of JSON values: of an array its items, of a lone object itself, else none."""
    return f"(CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE CAST([] AS JSON[]) END)"


_ELEMENTS = f"""
WITH raw AS (
  SELECT unit_key, {_decoded(_UNREADABLE.format(x="task_layer"))} AS t, {_decoded(_UNREADABLE.format(x="benchmark_views"))} AS b FROM all_units
), members AS (
  SELECT unit_key, 'task_layer.options' AS member_path, t -> '$.options' AS m FROM raw
  UNION ALL SELECT unit_key, 'benchmark_views.session_local_context', b -> '$.session_local_context' FROM raw
  UNION ALL SELECT unit_key, 'benchmark_views.full_history_context', b -> '$.full_history_context' FROM raw
  UNION ALL SELECT unit_key, 'benchmark_views.modality_conditioned_views.' || k || '.' || part, {_decoded("view")} -> ('$.' || part)
  FROM (SELECT unit_key, k, c -> ('$."' || k || '"') AS view
        FROM (SELECT unit_key, c, unnest(json_keys(c)) AS k
              FROM (SELECT unit_key, {_decoded("(b -> '$.modality_conditioned_views')")} AS c FROM raw) WHERE json_type(c) = 'OBJECT')),
       (SELECT unnest(['session_local_context', 'full_history_context']) AS part)
), windows AS (
  SELECT unit_key, i - 1 AS group_no, {_decoded("w[i]")} AS m
  FROM (SELECT unit_key, w, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT unit_key, {_as_array("r")} AS w FROM (SELECT unit_key, {_decoded("(b -> '$.retrieval_candidates')")} AS r FROM raw)))
), lists AS (
  SELECT unit_key, member_path, 0 AS group_no, {_as_array("m")} AS items FROM (SELECT unit_key, member_path, {_decoded("m")} AS m FROM members)
  UNION ALL SELECT unit_key, 'benchmark_views.retrieval_candidates', group_no, {_as_array("m")} FROM windows
), elements AS (
  SELECT unit_key, member_path, CAST(group_no AS INTEGER) AS group_no, CAST(i - 1 AS INTEGER) AS item_no, items[i] AS item
  FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM lists) WHERE items[i] IS NOT NULL AND json_type(items[i]) <> 'NULL'
  UNION ALL
  SELECT unit_key, 'history_evidence', 0, CAST(i - 1 AS INTEGER), NULL
  FROM (SELECT unit_key, history_evidence, unnest(range(1, len(history_evidence) + 1)) AS i FROM all_units) WHERE history_evidence[i] IS NOT NULL
)
"""

ORACLE_SQL = {
    "p3_found": _ORPHANS + "SELECT qa_key, ref_field, ref_pos, state FROM found WHERE state IS NOT NULL",
    "p3_report": _ORPHANS
    + "SELECT ref_field, strftime(created_at, '%Y-%m') AS month, state, count(*) AS n_references, count(DISTINCT qa_key) AS n_rows FROM found WHERE state IS NOT NULL GROUP BY ALL",
    "p5_found": _ELEMENTS + "SELECT unit_key, member_path, group_no, item_no FROM elements",
    "p5_turns": _ELEMENTS
    + f"SELECT unit_key, member_path, group_no, item_no, CASE WHEN json_type(e -> '$.speaker') <> 'NULL' THEN e ->> '$.speaker' END AS speaker, CASE WHEN json_type(e -> '$.text') <> 'NULL' THEN e ->> '$.text' END AS text FROM (SELECT *, {_decoded('item')} AS e FROM elements WHERE member_path LIKE 'benchmark_views.%')",
    "p5_member_sizes": _ELEMENTS + "SELECT member_path, count(*) AS n_elements, count(DISTINCT unit_key) AS n_units FROM elements GROUP BY ALL",
}
