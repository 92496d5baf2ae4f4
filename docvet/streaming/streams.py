"""The gate, the scan and the log as streams. Batches are written under their number, so one that runs again writes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docvet.functions import fixed
from docvet.operators import gate, logs
from docvet.plans.engine import vet
from docvet.sources import readers

PAYLOAD = "id string, event string, tool string, path string, response string"


def _written(out: str) -> Callable[[DataFrame, int], None]:
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def _start(df: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def payloads(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_per_batch).json(path)


def gate_stream(events: DataFrame, verdicts: DataFrame, out: str, checkpoint: str, settings: gate.Settings | None = None, available_now: bool = True) -> StreamingQuery:
    """Each payload's decision from the table of verdicts, read anew for every batch."""
    put = _written(out)
    return _start(events, lambda df, batch: put(gate.pre_read(df, verdicts, settings), batch), checkpoint, available_now)


def post_tool_stream(events: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """The invisible characters of each tool's response."""
    return _start(gate.post_tool(events.filter("event = 'PostToolUse'"), "response"), _written(out), checkpoint, available_now)


def scan_stream(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int = 1000, available_now: bool = True) -> StreamingQuery:
    """Verdicts of the files that are new under path; files that a batch has seen aren't scanned again. A file over
    MOST_FILE_BYTES isn't read and gets the verdict of a scan error."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path)
    found = readers.bounded(found, fixed.MOST_FILE_BYTES).withColumnRenamed("modificationTime", "modified")
    put = _written(out)
    return _start(found, lambda df, batch: put(vet(readers.documents(df), ["path", "length"]), batch), checkpoint, available_now)


def audit_stream(verdicts: DataFrame, log: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends an audit entry for each verdict of a stream."""
    return _start(verdicts, lambda df, batch: logs.audit_entries(df).write.mode("overwrite").json(f"{log}/batch={batch}"), checkpoint, available_now)


def per_hour(findings: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Findings by hour and severity; an addition, for streams of findings and tables alike."""
    df = findings.withWatermark(at, late) if findings.isStreaming else findings
    return df.groupBy(F.window(at, "1 hour"), "severity").count()


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events with their number; an addition."""
    df = events.withWatermark(at, late) if events.isStreaming else events
    return df.groupBy(F.session_window(at, gap), user).count()
