"""Exact duplicates by a stateful stream. Only DataFrame operations and the state store's own code touch the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docvet.llm.shared import Scratch, few, fresh, from_files, settings, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The state lies on disk; without fallocate, so that many small stores don't each reserve megabytes, and with one bound on
#: the memory of all stores of an executor.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def normalised(text: Column) -> Column:
    """A-Z in lower case; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def located(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column name: the file (a hash of its path) and the row there of each document."""
    meta = docs.metadataColumn("_metadata")
    return docs.select("*", F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")).alias(name))


def keep_states(tmp: Scratch, feed_path: str, feed: DataFrame, files_per_batch: int | None) -> DataFrame:
    """Streams the feed (digest, doc_id, at) through keyed state: per digest the number of documents and the stable
    identifier and content locator of the one that stays. The state lies in RocksDB and on the shared disk and never
    expires; each batch puts the states that it changed into a table, and the newest of each digest is returned."""
    spark, work = tmp.spark, tmp.path("states")
    stream = spark.readStream.schema(feed.schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    states = (
        stream.parquet(feed_path)
        .groupBy("digest")
        .agg(F.max(F.struct(F.col("doc_id"), F.col("at"))).alias("stays"), F.count("*").alias("group_size"))
    )

    def put(changed: DataFrame, batch: int) -> None:  # a batch that runs again overwrites what it wrote
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{work}/changed/batch={batch}")

    with settings(spark, ROCKSDB):
        query = (
            states.writeStream.outputMode("update").foreachBatch(lambda df, batch: put(df.select("digest", "stays", "group_size"), batch))
            .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    schema = f"digest string, stays {feed.select(F.struct('doc_id', 'at')).dtypes[0][1]}, group_size long, batch long"
    try:
        changed = spark.read.schema(schema).parquet(f"{work}/changed")
    except Exception as e:
        if type(e).__name__ != "AnalysisException":
            raise
        changed = spark.createDataFrame([], schema)  # no batch ran: no documents
    if changed.select("batch").distinct().count() > 1:
        changed = changed.groupBy("digest").agg(F.max_by(F.struct("stays", "group_size"), "batch").alias("s")).select("digest", "s.stays", "s.group_size")
    return changed.select("digest", "stays", "group_size")


def exact_dedup(docs: DataFrame, hashed: Callable[[Column], Column] = digest, files_per_batch: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, at.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of a group the row with the
    largest doc_id stays; null is the smallest, and of rows that repeat a doc_id the last by place stays. Other columns of
    docs are neither needed nor touched. No documents: no rows.

    A pass over the texts feeds digests, identifiers and locators to the stream (keep_states). On a hit, a digest that
    came more than once, the bytes of all its texts are compared: the smallest and the largest text of the digest, found
    by partial sums before the shuffle, are the same only if all are. Digests of different texts are grouped anew by text.
    hashed can be replaced to try that.
    """
    with Scratch(docs.sparkSession) as tmp:
        return stored(_found(tmp, docs, hashed, files_per_batch), "copies")


def _found(tmp: Scratch, docs: DataFrame, hashed: Callable[[Column], Column] = digest, files_per_batch: int | None = None) -> DataFrame:
    spark = tmp.spark
    docs = from_files(docs)
    at = fresh(docs, "_at")
    source = located(docs, at).select("doc_id", "text", F.col(at).alias("_at"))
    text = normalised(F.col("text"))
    rows = source.select(F.col("doc_id"), hashed(text).alias("digest"), F.col("_at").alias("at"))
    feed_path = tmp.path("feed")
    rows.write.parquet(feed_path)
    feed = spark.read.schema(rows.schema).parquet(feed_path)
    states = keep_states(tmp, feed_path, feed, files_per_batch)

    hits = few(states.filter("group_size > 1").select("digest"))
    seen = source.select(hashed(text).alias("digest"), text.alias("_text")).join(hits, "digest", "left_semi")
    differ = seen.groupBy("digest").agg(F.min("_text").alias("a"), F.max("_text").alias("b")).filter("a <> b").select("digest")
    differ = tmp.stored(differ, "differ")
    out = feed.join(states, "digest").select(
        "doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("stays.at")).alias("kept"), "digest", "at"
    )
    if not differ.isEmpty():
        again = source.select("doc_id", hashed(text).alias("digest"), F.col("_at").alias("at"), text.alias("_text")).join(differ, "digest", "left_semi")
        group = Window.partitionBy("digest", "_text")
        last = F.max(F.struct("doc_id", "at")).over(group)
        again = again.select("doc_id", last["doc_id"].alias("keep_id"), F.count("*").over(group).alias("group_size"), (F.col("at") == last["at"]).alias("kept"), "digest", "at")
        out = out.join(differ, "digest", "left_anti").unionByName(again)
    if hashed is not digest:
        names = source.select(F.col("_at").alias("at"), digest(text).alias("text_sha256"))
        return out.drop("digest").join(names, "at").select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "at")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "at")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    docs = from_files(docs)
    at = fresh(docs, "_at")
    source = located(docs, at)
    with Scratch(docs.sparkSession) as tmp:
        gone = few(stored(_found(tmp, docs).filter("not kept").select("at"), "gone"))
    return source.join(gone, source[at] == gone["at"], "left_anti").drop(at)
