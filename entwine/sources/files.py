"""Tab-separated sources and sinks, JSON reports."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
#: Strings that tabular readers take as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)


def read_tsv(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """A headed TSV with an explicit schema; the usual strings for missing values become null. A quoted field may hold
    line feeds; without `multiline` a file can be read by several tasks."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, quote='"', escape='"', multiLine=multiline)
    return rows.select(*[F.when(F.col(c).isin(*MISSING), None).otherwise(F.col(c)).alias(c) for c in rows.columns])


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, SOURCE)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, TRUTH)


def write_tsv(rows: DataFrame, path: str, single: bool = False) -> None:
    """A folder of headed TSV parts; single writes one part, for small reports. White space at the ends of values stays."""
    parts = rows.coalesce(1) if single else rows
    parts.write.mode("overwrite").csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, dropped when the driver ends; a local session without
    that setting takes a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def report_json(report: DataFrame) -> str:
    """A one-row report as a JSON line."""
    return json.dumps(report.first().asDict())
