"""Sources and ground truth from a folder of TSV files, or synthetic ones where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .files import read_source, read_truth, write_tsv
from .records import synthetic

NAMES = ("source1", "source2", "source3")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load(spark: SparkSession, folder: str, prefix: str = "sample", **sizes) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """<prefix>_source1..3.tsv and <prefix>_ground_truth.tsv of a folder; synthetic tables if the first is not there."""
    if not exists(spark, f"{folder}/{prefix}_source1.tsv"):
        return synthetic(spark, **sizes)
    return *(read_source(spark, f"{folder}/{prefix}_{n}.tsv") for n in NAMES), read_truth(spark, f"{folder}/{prefix}_ground_truth.tsv")


def save(sources: list[DataFrame], truth: DataFrame, folder: str, prefix: str = "sample") -> None:
    """The same files, one part each: for samples, which are small by construction."""
    for name, rows in zip(NAMES, sources):
        write_tsv(rows.select("entity_id", "business_name", "business_address", "country"), f"{folder}/{prefix}_{name}.tsv", single=True)
    write_tsv(truth, f"{folder}/{prefix}_ground_truth.tsv", single=True)
