"""One plan from files or tables to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvet.functions import fixed, ir
from docvet.operators import detectors, logs, policy, reports, sanitize, scoring
from docvet.sources import readers

VIEWS = ("documents_ir", "paragraphs", "runs", "evidence", "reports", "verdicts")


def vet(docs: DataFrame, keys: list[str], mode: str = "strip", severity: str | None = None, skip: tuple[str, ...] = (), rules: policy.Policy | None = None, clean: bool = True, kinds: tuple[str, ...] = (*fixed.DOCUMENT_KINDS, "text")) -> DataFrame:
    """Documents of the model to verdicts: evidence, sanitized, scores, label, reasons, risk, decision.

    severity: weaker findings are left out before anything is scored. skip: detectors that don't run. clean: whether the
    sanitized text is wanted. kinds: those that docs can have.
    """
    out = detectors.detect(docs, keys, skip, kinds)
    if severity:
        out = out.withColumn("evidence", scoring.at_least(F.col("evidence"), severity))
    out = sanitize.sanitize(out, mode) if clean else out
    return policy.decide(scoring.trust(out, ir.all_text()), rules)


class Engine:
    """Scans files under a path. Every method returns a DataFrame; nothing runs until it is asked for rows."""

    def __init__(self, spark: SparkSession, mode: str = "strip", rules: policy.Policy | None = None, most_bytes: int = fixed.MOST_FILE_BYTES):
        self.spark, self.mode, self.rules, self.most_bytes = spark, mode, rules, most_bytes

    def files(self, path: str, recursive: bool = True) -> DataFrame:
        return readers.files(self.spark, path, recursive, self.most_bytes)

    def process(self, path: str, recursive: bool = True, severity: str | None = None, skip: tuple[str, ...] = (), clean: bool = True) -> DataFrame:
        return vet(readers.documents(self.files(path, recursive)), ["path", "length"], self.mode, severity, skip, self.rules, clean)

    def scan(self, path: str, recursive: bool = True, severity: str = "info", skip: tuple[str, ...] = ()) -> DataFrame:
        """path, report (JSON) and exit_code of each file."""
        found = detectors.detect(readers.documents(self.files(path, recursive)), ["path", "length"], skip)
        found = found.withColumn("exit_code", scoring.exit_code(severity)).withColumn("evidence", scoring.at_least(F.col("evidence"), severity))
        return reports.to_json(found).select("path", "report", "exit_code")

    def exit_code(self, path: str, recursive: bool = True, severity: str = "info", skip: tuple[str, ...] = ()) -> int:
        """The largest exit code of the files under the path; 0 where there are none."""
        return self.scan(path, recursive, severity, skip).agg(F.max("exit_code")).first()[0] or 0

    @staticmethod
    def weaker_left_out(found: DataFrame, severity: str) -> DataFrame:
        return found.withColumn("evidence", scoring.at_least(F.col("evidence"), severity))

    def write_reports(self, path: str, out: str, reporter: str = "jsonl", recursive: bool = True, severity: str = "info", skip: tuple[str, ...] = ()) -> None:
        """Writes the files' reports, in the order of their paths, as lines of text under out."""
        found = detectors.detect(readers.documents(self.files(path, recursive)), ["path", "length"], skip)
        reports.reporter(reporter)(self.weaker_left_out(found, severity)).write.text(out)

    def sanitized(self, path: str) -> DataFrame:
        return self.process(path).select("path", "sanitized.text", F.size("sanitized.removed").alias("removed_count"), F.size("evidence").alias("evidence_count"))

    def trust(self, path: str) -> DataFrame:
        return self.process(path, clean=False).select("path", "label", "score", "structure", "content", "meta", "reasons")

    def policy(self, path: str, audit: str | None = None) -> DataFrame:
        verdicts = self.process(path, clean=False)
        if audit:
            logs.append(logs.audit_entries(verdicts), audit)
        return verdicts.select("path", "decision.*")

    def namespace(self) -> str:
        """What the engine's decisions depend on beside the file. Rules of its own count with their tests as text; where that
        text differs from one session to the next, the cache is missed, never wrongly hit."""
        own = tuple(f"{r.id}|{r.action}|{r.reason}|{r.when}" for r in self.rules.rules) + (self.rules.name,) if self.rules else None
        space = logs.namespace(self.mode) if own is None else logs.namespace(self.mode, own)
        return space if self.most_bytes == fixed.MOST_FILE_BYTES else f"{space}|{self.most_bytes}"

    def incremental(self, path: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Decisions that the cache has, and verdicts of the files that it lacks, which alone are read and scanned."""
        hits, misses = logs.cache_split(self.files(path), cache, self.namespace())
        verdicts = vet(readers.documents(misses.drop("sha256")), ["path", "length"], self.mode, rules=self.rules)
        return hits.drop("content"), verdicts.join(misses.select("path", "sha256"), "path")

    def audit_tail(self, path: str, n: int = 100) -> DataFrame:
        return logs.tail(logs.read(self.spark, path), n)

    def approvals(self, path: str) -> DataFrame:
        return logs.pending(logs.read(self.spark, path, logs.APPROVAL))

    def decide(self, path: str, request: str, status: str, by: str) -> int:
        """Appends a decision; the number of requests that it decided, 0 or 1."""
        row = logs.decide(logs.read(self.spark, path, logs.APPROVAL), request, status, by).collect()
        if row:
            logs.append(self.spark.createDataFrame(row, logs.APPROVAL), path)
        return len(row)

    def detectors(self) -> DataFrame:
        return self.spark.createDataFrame([(k, n, kinds.split()) for k, (n, kinds) in fixed.DETECTORS.items()], "id string, name string, kinds array<string>")

    def views(self, verdicts: DataFrame, key: str = "path") -> None:
        """Temporary views of the verdicts for SQL: VIEWS."""
        paragraphs = verdicts.select(key, F.posexplode("paragraphs").alias("pos", "p")).select(key, "pos", "p.*")
        tables = {
            "documents_ir": verdicts.select(key, *ir.COLUMNS), "paragraphs": paragraphs.drop("runs"), "runs": paragraphs.select(key, "pos", F.posexplode("runs").alias("run", "r")).select(key, "pos", "run", "r.*"),
            "evidence": reports.findings(verdicts, [key]), "reports": reports.to_json(verdicts).select(key, "report"), "verdicts": verdicts.drop("paragraphs", "nodes", "parts"),
        }
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
