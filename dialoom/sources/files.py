"""Readers and sinks for the file layouts: nested JSON documents, bundles, text reports, CSV, Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One item of a text report: '<n>. Item <n>:' up to the next one.
ITEM_BLOCK = r"(?ms)^\d+\.\sItem\s\d+:.*?(?=^\d+\.\sItem\s\d+:|\z)"


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, value): the text of each JSON file, with the folder it lies in."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1).alias("scenario"), "value")


def typed_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of multi-line JSON files under a declared schema; rows that do not fit are kept aside by column."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def bundle(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """One row per scenario folder with a text column per file of the bundle."""
    out = None
    for name in names:
        part = whole_json(spark, f"{root}/scenario_*/{name}.json").withColumnRenamed("value", name)
        out = part if out is None else out.join(part, "scenario", "full")
    return out


def report_items(reports: DataFrame) -> DataFrame:
    """(report, item_no, block, unit_id, answer) of text reports (columns report, value)."""
    blocks = reports.select("report", F.posexplode(F.regexp_extract_all("value", F.lit(ITEM_BLOCK), F.lit(0))).alias("item_no", "block"))
    unit = F.regexp_extract("block", r"'unit_id': '([^']+)'", 1)
    answer = F.regexp_extract("block", r"(?s)Actual:\s+(\{.*?\})(?:\s*\n\s*Scores:|\s*\n\s*Trace ID:)", 1)
    return blocks.withColumn("unit_id", F.nullif(F.trim(unit), F.lit(""))).withColumn("answer", F.nullif(answer, F.lit("")))


def write_json(df: DataFrame, path: str, *by: str) -> None:
    """JSON lines, null fields left out, one folder per value of the partition columns."""
    df.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", True).json(path)


def write_missing(df: DataFrame, path: str, key: str) -> None:
    """Append only rows whose key the table at ``path`` does not hold yet."""
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, scores: str | None = None, metrics: tuple[str, ...] = ()) -> None:
    """CSV with header and a byte-order mark before it; a map column of scores is spread over columns."""
    if scores:
        df = df.select(*[c for c in df.columns if c != scores], *[F.col(scores)[m].alias(m) for m in metrics])
    first, *rest = df.columns
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def quarantine(df: DataFrame, is_bad: str, good_path: str, bad_path: str) -> None:
    """Good rows and broken rows to separate tables."""
    df.where(f"not coalesce({is_bad}, false)").write.mode("overwrite").parquet(good_path)
    df.where(f"coalesce({is_bad}, false)").write.mode("overwrite").parquet(bad_path)


def markdown(title: str, summary: DataFrame) -> str:
    """A small summary table as Markdown (one row per group; summaries are bounded by their groups)."""
    names = summary.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in summary.toLocalIterator()]
    return "\n".join(lines) + "\n"


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def scenarios(spark: SparkSession, root: str) -> list[str]:
    """Names of the scenario folders in order; an error if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/scenario_*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(s.getPath().getName() for s in found if s.isDirectory())
    if not names:
        raise FileNotFoundError(f"no scenario folders in {root}")
    return names


def units(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(pos, value): the units of a JSON array file in their order, the first ones if asked for."""
    each = whole_json(spark, path).select("scenario", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "value"))
    return each.orderBy("scenario", "pos").limit(first) if first is not None else each


def lookup(spark: SparkSession, path: str) -> dict:
    """A small settings or template file, read on the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One text column as lines."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_bundle(bundles: DataFrame, root: str, names: list[str]) -> None:
    """Each file of a bundle under its own folder, partitioned by scenario."""
    for name in names:
        bundles.where(F.col(name).isNotNull()).select("scenario", F.col(name).alias("value")).write.mode("overwrite").partitionBy("scenario").text(f"{root}/{name}")


def write_run_table(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The table of a run as CSV with its fixed columns; its first bytes are the byte-order mark that spreadsheets look for."""
    write_csv(rows.select(*columns), path)
