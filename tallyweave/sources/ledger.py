"""Batches and runs as Parquet tables that a manifest publishes."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import dedup
from ..operators import report as reports
from ..plans.engine import Result, reconcile
from ..plans.rules import RuleSet
from ..schema import RECORD_COLUMNS
from . import feeds
from .feeds import Source

MANIFEST = "kind string, id string, status string, source_id string, idempotency_key string, file_digest string, row_policy string, detail string, seq long"
TERMINAL = {"batch": ("committed", "failed"), "run": ("succeeded", "failed", "cancelled")}


class Conflict(ValueError):
    """The same idempotency key with another file, or a transition out of a terminal state."""


class Fault(RuntimeError):
    """Raised by an injected fault."""


@dataclass
class Ledger:
    """Submit feeds, run rules, read reports.

    Data goes below ``root`` first; a manifest row then publishes it, so a lost job leaves
    nothing half visible. One writer at a time is assumed, as Parquet has no transactions.
    ``faults`` names steps (parse, staging_commit, candidate_gen, result_commit) that fail, for tests.
    """

    spark: SparkSession
    root: str
    now: str = "1970-01-01T00:00:00Z"
    faults: tuple[str, ...] = ()

    def __post_init__(self):
        self.sources: dict[str, Source] = {}
        self.rulesets: dict[int, RuleSet] = {}

    # Manifest

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def _entries(self, kind: str) -> DataFrame:
        """The latest row of each id."""
        return self._manifest().where(F.col("kind") == kind).groupBy("id").agg(F.max_by(F.struct("*"), "seq").alias("e")).select("e.*")

    def _entry(self, kind: str, id_: str):
        return self._entries(kind).where(F.col("id") == id_).first()

    def _publish(self, kind: str, id_: str, status: str, **more) -> None:
        old = self._entry(kind, id_)
        if old is not None and old.status in TERMINAL[kind]:
            raise Conflict(f"{kind} {id_} is {old.status}")
        seq = 0 if old is None else old.seq + 1
        row = {c: None for c in ("source_id", "idempotency_key", "file_digest", "row_policy", "detail")} | (old.asDict() if old is not None else {}) | more
        row |= {"kind": kind, "id": id_, "status": status, "seq": seq}
        self.spark.createDataFrame([tuple(row[c.split()[0]] for c in MANIFEST.split(", "))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _fault(self, step: str) -> None:
        if step in self.faults:
            raise Fault(step)

    # Sources, rules

    def add_source(self, source: Source) -> None:
        self.sources[source.source_id] = source

    def put_ruleset(self, rules: RuleSet) -> int:
        revision = max(self.rulesets, default=0) + 1 if rules.revision in self.rulesets else rules.revision
        self.rulesets[revision] = RuleSet(rules.rules, revision)
        return revision

    # Batches

    def submit_batch(self, source_id: str, path: str, idempotency_key: str, row_policy: str = "isolate", batch_id: str | None = None) -> str:
        """Import the files at ``path``; the same key and content of a source give the same batch again.

        ``atomic`` fails the batch at any bad row; any other policy isolates bad rows. A
        failed batch may be sent again under its key.
        """
        if not idempotency_key:
            raise ValueError("an idempotency key is needed")
        source = self.sources[source_id]
        files = self.spark.read.format("binaryFile").load(path).select("path", "content")
        digests = files.select("path", feeds.file_digest(F.col("content")).alias("d")).orderBy("path").collect()  # a row a file of one feed
        digest = "|".join(r.d for r in digests)
        same = self._entries("batch").where((F.col("source_id") == source_id) & (F.col("idempotency_key") == idempotency_key) & (F.col("status") != "failed")).first()
        if same is not None:
            if same.file_digest != digest:
                raise Conflict(f"key {idempotency_key} belongs to another file")
            if same.status == "committed":
                return same.id
        id_ = same.id if same is not None else batch_id or f"b-{uuid.uuid4().hex[:16]}"
        given = {"source_id": source_id, "idempotency_key": idempotency_key, "file_digest": digest, "row_policy": row_policy}
        if same is None:
            self._publish("batch", id_, "receiving", **given)
        try:
            self._fault("parse")
            records = feeds.read_feed(self.spark, path, source, id_)
            target = f"{self.root}/records/batch_id={id_}"
            records.drop("batch_id", "error").write.mode("overwrite").parquet(target)
            records.where("error is not null").select("error.*").write.mode("overwrite").parquet(f"{self.root}/errors/batch_id={id_}")
            self._fault("staging_commit")
            summary = feeds.batch_summary(self.records([id_])).first()
            bad = summary is not None and summary.invalid_count > 0
            detail = json.dumps(summary.asDict() if summary is not None else {})
        except Exception:
            self._publish("batch", id_, "failed")
            raise
        self._publish("batch", id_, "failed" if bad and row_policy == "atomic" else "committed", detail=detail)
        return id_

    def records(self, batch_ids: list[str]) -> DataFrame:
        """Records of the batches in the order that ties fall by: (source_id, source_line, place of the batch)."""
        order = F.create_map(*[F.lit(x) for i, b in enumerate(batch_ids) for x in (b, i)])
        rows = self.spark.read.option("basePath", f"{self.root}/records").parquet(*[f"{self.root}/records/batch_id={b}" for b in batch_ids])
        return rows.withColumn("batch_id", F.col("batch_id").cast("string")).withColumn("batch_ord", order[F.col("batch_id")]).select(*RECORD_COLUMNS)

    def batches(self) -> DataFrame:
        return self._entries("batch").orderBy("id")

    def retransmits(self, batch_id: str) -> DataFrame:
        """(record_id, earlier_id, earlier_batch): rows that an earlier committed batch of the same file content had already."""
        mine = self._entry("batch", batch_id)
        twins = [r.id for r in self._entries("batch").where((F.col("file_digest") == mine.file_digest) & (F.col("status") == "committed") & (F.col("id") != batch_id)).collect()]
        own = self.records([batch_id])
        return dedup.retransmits(own, self.records(twins) if twins else own.where("false"))

    # Runs

    def start_run(self, run_id: str, batch_ids: list[str], revision: int = 0) -> str:
        """Reconcile committed batches under a frozen revision (0: the latest) and publish the results."""
        states = {r.id: r.status for r in self._entries("batch").where(F.col("id").isin(batch_ids)).collect()}
        for b in batch_ids:
            if states.get(b) != "committed":
                raise ValueError(f"batch {b} is not committed")
        rules = self.rulesets[revision or max(self.rulesets)]
        if self._entry("run", run_id) is not None:
            raise Conflict(f"run {run_id} exists")
        self._publish("run", run_id, "running", detail=json.dumps({"batch_ids": batch_ids, "revision": rules.revision, "generated_at": self.now}))
        try:
            self._fault("candidate_gen")
            result = reconcile(self.records(batch_ids), list(rules.rules))
            for name in ("groups", "discrepancies", "duplicates"):
                getattr(result, name).withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(f"{self.root}/runs/{run_id}/{name}")
            self._fault("result_commit")
        except Exception:
            self._publish("run", run_id, "failed")
            raise
        self._publish("run", run_id, "succeeded")
        return run_id

    def cancel_run(self, run_id: str) -> None:
        if self._entry("run", run_id) is None:
            raise KeyError(run_id)
        self._publish("run", run_id, "cancelled")

    def run(self, run_id: str):
        entry = self._entry("run", run_id)
        if entry is None:
            raise KeyError(run_id)
        return entry

    def runs(self) -> DataFrame:
        return self._entries("run").orderBy("id")

    def result(self, run_id: str) -> Result:
        entry = self.run(run_id)
        if entry.status != "succeeded":
            raise ValueError(f"run {run_id} is {entry.status}")
        parts = {n: self.spark.read.parquet(f"{self.root}/runs/{run_id}/{n}").drop("run_id") for n in ("groups", "discrepancies", "duplicates")}
        return Result(records=self.records(json.loads(entry.detail)["batch_ids"]), **parts)

    def report(self, run_id: str, format: str = "json") -> str:
        """The report as text; its time is that of the run, so exports agree byte for byte."""
        detail = json.loads(self.run(run_id).detail)
        built = reports.build(self.result(run_id), run_id, detail["generated_at"], detail["revision"], detail["batch_ids"])
        return reports.to_json(built) if format == "json" else reports.to_csv(built)

    def recover(self) -> None:
        """Fail batches and runs that a lost driver left unfinished."""
        for kind in ("batch", "run"):
            for r in self._entries(kind).where(~F.col("status").isin(*TERMINAL[kind])).collect():
                self._publish(kind, r.id, "failed")
