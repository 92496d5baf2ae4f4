"""What the operators share: written tables in the shared folder, gapless ranks without a hot task, guarded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a narrow table (a few dozen bytes each) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may fall back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_docvet_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark._docvet_shared = tempfile.mkdtemp(prefix="docvet-")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docvet/{name}-{uuid.uuid4().hex[:12]}"


#: What holds while an intermediate table is written. Shuffle files go when the write ends, since nothing reads them again.
#: Texts are long, and a batch of them lies in memory of the JVM and of Python at once, so batches have few rows.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    with settings(spark, WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own, which stays until delete() or the end of the driver: for what is given back."""
    path = new_path(df.sparkSession, name)
    _KEPT.append((df.sparkSession, path))
    return written(df, path)


_KEPT: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


@atexit.register
def _delete_kept() -> None:
    for spark, path in _KEPT:
        with contextlib.suppress(Exception):  # the driver's JVM may be gone
            delete(spark, path)


class Scratch:
    """The tables of one run of an operator; they are deleted when its block ends, so what it gives back must be stored()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def path(self, name: str) -> str:
        self.paths.append(new_path(self.spark, name))
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, self.path(name))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def from_files(docs: DataFrame) -> DataFrame:
    """docs that come straight from files as they are, others written to the shared folder first."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  resolves the column
        return docs
    except Exception as e:
        if type(e).__name__ != "AnalysisException":
            raise
        return stored(docs, "docs")


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows (counted on a written table), else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def file_starts(docs: DataFrame) -> DataFrame:
    """Of each file of docs, which come straight from files: _file, its path, and _first, the number of rows in the files
    before it, in the order of their names. A short row a file."""
    meta = docs.metadataColumn("_metadata")
    files = docs.select(meta["file_path"].alias("_file"), meta["row_index"].alias("_row")).groupBy("_file").agg(F.max("_row").alias("_last"))
    before = Window.orderBy(F.length("_file"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("_file", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_first"))


def numbered(df: DataFrame, group: str, order: list, out: str, rows: int, by: Column | None = None, per_bucket: int = 50_000) -> DataFrame:
    """df and a column out: a gapless number from 0 within each value of group.

    Rows are dealt by a hash of the order columns into buckets of about per_bucket rows, numbered there, and each bucket
    starts where the one before ends; so a group with a third of all rows is numbered by many tasks. The order within a group
    is thus pseudo-random but fixed: (bucket, order columns). by: a whole number that the order columns never lessen, and that
    few rows share; then it makes the buckets, and the order is that of the columns. df is read twice and must give the same
    rows both times. group is never null, so the join is on the columns by which the rows are dealt and moves them no further.
    """
    buckets = max(1, -(-rows // per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if by is None else F.floor(by / per_bucket).cast("int"))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_at")))
        .withColumn(out, (F.col("_start") + F.col("_r")).cast("long"))
        .drop("_bucket", "_group", "_at", "_start", "_r")
    )
