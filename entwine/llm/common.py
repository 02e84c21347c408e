"""Shared pieces of the training-data operators: staging, word rules, row numbers, gapless ranks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java/RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


#: Digits, letters and all non-ASCII bytes stay, A-Z become lower case, other ASCII becomes a space.
LETTERS = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
#: Ids of eight bytes up to which `without` broadcasts (some 50 MB in an executor).
BROADCAST_ROWS = 1_000_000
#: The column of row numbers while a stage decides.
ROW = "_entwine_row"
#: Folders of local sessions by application.
_local: dict[str, str] = {}
#: For each passing() that is open, the paths staged in it.
_passing: list[list[str]] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a
    folder of its own; a cluster has no folder that is known to be shared, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="entwine-")
    return _local[context.applicationId]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; the file system drops it when the driver ends."""
    path = f"{work_dir(spark)}/entwine/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    for paths in _passing:
        paths.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes when this ends, but for what without() needs. Nothing else that was worked out inside may
    be used afterwards."""
    paths: list[str] = []
    _passing.append(paths)
    try:
        yield
    finally:
        _passing.pop()
        for path in paths:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: str = "text") -> Column:
    """The column's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and the other letters."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(docs: DataFrame) -> DataFrame:
    """docs, staged, with a number in ROW that no two rows share: a doc_id may be null or repeated."""
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def by_row(rows: DataFrame) -> DataFrame:
    """The rows' numbers in place of their doc_id, and their texts, for operators that read doc_id and text."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def outnumbered(rows: DataFrame, groups: DataFrame, keep: str = "min", repeats: bool = True) -> DataFrame:
    """The numbers of the rows that leave their group, given groups (doc_id, group) with row numbers as doc_id.

    The smallest (or, for "max", the largest) doc_id of a group stays, null only in a group of null ids alone. With
    repeats all rows of that doc_id stay, else the one with the smallest number. Nothing is gathered by group but
    one row per task; rows meet what stays by their own number or by group and doc_id.
    """
    members = stage(groups.select(F.col("doc_id").alias(ROW), "group").join(rows.select(ROW, F.col("doc_id").alias("_id")), ROW), "members")
    if keep == "min":
        best = F.min(F.struct(F.isnull("_id").alias("x"), "_id", F.col(ROW).alias("r")))["r"]
    else:
        best = -F.max(F.struct(F.isnotnull("_id").alias("x"), "_id", (-F.col(ROW)).alias("r")))["r"]
    stay = stage(members.groupBy("group").agg(best.alias(ROW)).select(ROW), "stay")
    if not repeats:
        return members.join(stay, ROW, "left_anti").select(ROW)
    stay = members.join(stay, ROW, "left_semi").select(F.col("group").alias("g"), F.col("_id").alias("i"))
    return members.join(stay, (F.col("group") == F.col("g")) & F.col("_id").eqNullSafe(F.col("i")), "left_anti").select(ROW)


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """numbered() rows without those whose numbers are in gone (unique), all columns as they were before numbering.

    The numbers are counted first: up to BROADCAST_ROWS of them go to every executor, so that texts are not shuffled;
    more are joined by a shuffle.
    """
    ids = stage(gone.select(ROW), "gone")
    for paths in _passing:
        paths.pop()  # the last path is that of ids, which the result reads
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, ROW, "left_anti").drop(ROW)


def join_spread(many: DataFrame, one: DataFrame, on: str, size: str, salt: str, hot: int = 20_000) -> DataFrame:
    """many joined with one, which has a row for each value of `on` and in `size` the number of many's rows under it.

    A value with more than `hot` rows is dealt over several tasks: its row of `one` is repeated for every `hot` of them
    and many's rows choose among the repeats by a hash of the column `salt`. `hot` grows with the table, so that at most 100,000
    values are hot; these are broadcast with their numbers of repeats.
    """
    total = one.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    repeats = F.ceil(F.col(size) / max(hot, total // 100_000)).cast("long")
    heavy = one.where(repeats > 1).select(on, repeats.alias("_repeats"))
    dealt = many.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.pmod(F.xxhash64(salt), F.coalesce("_repeats", F.lit(1).cast("long")))).drop("_repeats")
    spread = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(repeats, F.lit(1).cast("long")) - 1))).drop(size)
    return dealt.join(spread, [on, "_salt"]).drop("_salt")


def gapless(df: DataFrame, group: str, order: list[str], rows: int, name: str, per_cell: int = 200_000) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... without bringing a group into one task.

    Rows are dealt into hash cells; the cells' counts give each cell's offset inside its group, and a window
    numbers the rows of one cell. df must give the same rows each time it is read (a staged table). Rows that
    agree in all of `order` may swap numbers. Memory per task: one cell, about per_cell rows, whatever the group.
    """
    cells = max(64, -(-rows // per_cell))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order)
    ranked = dealt.withColumn("_at", F.row_number().over(inside))
    return ranked.join(offsets, [group, "_cell"]).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_cell", "_at", "_before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node, component its smallest node.

    Alternates large-star and small-star (Kiveris et al., 2014) until the edges stay the same. Each round is
    two shuffles of the edge list and is written to the shared folder; nothing is collected but two sums.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            out = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    now, seen = stage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges"), None
    while True:
        now = stage(star(star(now, True), False), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    members = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots.join(members, "node", "left_anti"))
