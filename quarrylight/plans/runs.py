"""Runs of extractors: what they need is checked first, they end in time, and what they finished is not done again.

An extractor is a function of a session and a project that gives its phases, a table each, as plans. A phase's rows replace the
project's rows of that table in one commit, so a run that ends early leaves each table as it was or as it should be. The
ledger is a folder of appended rows.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.checks import slug_ok
from quarrylight.operators import ledger
from quarrylight.operators.stored import ScopedTable, names_in

LOG = "run_id string, event string, at timestamp, project string, extractor string, state string, phase string, count long, success boolean, error_code string, message string, nodes long, edges long"
Extractor = Callable[[SparkSession, str], Mapping[str, DataFrame]]


class ExtractorError(RuntimeError):
    """What an extractor raises to name its error."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


@dataclass
class Outcome:
    run_id: str | None
    success: bool
    error_code: str | None = None
    message: str | None = None
    written: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


class Runner:
    """Runs extractors over registered projects into a folder (tables/<phase>, ledger)."""

    def __init__(self, spark: SparkSession, folder: str, extractors: Mapping[str, Extractor], projects: DataFrame):
        self.spark, self.folder, self.extractors, self.projects = spark, folder.rstrip("/"), dict(extractors), projects

    def table(self, phase: str) -> ScopedTable:
        return ScopedTable(self.spark, f"{self.folder}/tables/{phase}", ["project"])

    def log(self) -> DataFrame:
        """The ledger's rows."""
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/ledger") if names_in(self.spark, f"{self.folder}/ledger") else self.spark.createDataFrame([], LOG)

    def runs(self) -> DataFrame:
        return ledger.runs(self.log().where("event in ('start', 'end')"))

    def _note(self, **row) -> None:
        columns = [c.split()[0] for c in LOG.split(", ")]
        at = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        self.spark.createDataFrame([tuple((row | {"at": at}).get(c) for c in columns)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def _refused(self, name: str, project: str) -> Outcome | None:
        one = self.spark.createDataFrame([(project,)], "slug string")
        if not one.where(slug_ok(F.col("slug"))).take(1):
            return Outcome(None, False, "invalid_slug", f"{project!r} is no slug")
        if name not in self.extractors:
            return Outcome(None, False, "unknown_extractor", f"no extractor {name!r}")
        if not self.projects.where(F.col("slug") == project).take(1):
            return Outcome(None, False, "project_not_registered", f"no project {project!r}")
        return None

    def _done(self, name: str, project: str, state: str | None) -> set[str]:
        """The phases that the last run, if it failed, finished over the same state of the project."""
        if state is None:
            return set()
        own = self.log().where((F.col("extractor") == name) & (F.col("project") == project))
        last = own.where("event = 'end'").orderBy(F.desc("at")).select("run_id", "success", "state").first()
        if last is None or last["success"] or last["state"] != state:
            return set()
        return {r["phase"] for r in own.where((F.col("event") == "phase") & (F.col("run_id") == last["run_id"])).select("phase").collect()}

    def run(self, name: str, project: str, state: str | None = None, timeout_seconds: float = 300.0) -> Outcome:
        """Run an extractor; never raises for what goes wrong in it. state: what the project's input is (a commit, say); a run
        after a failed one over the same state goes on behind the phases that one finished."""
        refused = self._refused(name, project)
        if refused:
            return refused
        outcome = Outcome(str(uuid.uuid4()), False)
        done = self._done(name, project, state)
        base = {"run_id": outcome.run_id, "project": project, "extractor": name, "state": state}
        self._note(event="start", **base)
        stop = threading.Event()

        def work() -> None:
            context = self.spark.sparkContext
            context.setJobGroup(outcome.run_id, f"{name} of {project}", interruptOnCancel=True)
            try:
                for phase, rows in self.extractors[name](self.spark, project).items():
                    if phase in done:
                        outcome.skipped.append(phase)
                        self._note(event="phase", phase=phase, **base)
                        continue
                    if stop.is_set():
                        return
                    table = self.table(phase)
                    own = rows.withColumn("project", F.lit(project))
                    version = table.replace(own, self.spark.createDataFrame([(project,)], "project string"))
                    if stop.is_set():  # written, but the run has ended: the next one does it again
                        return
                    outcome.written[phase] = table.read(version).where(F.col("project") == project).count()
                    self._note(event="phase", phase=phase, count=outcome.written[phase], **base)
                outcome.success = True
            except ExtractorError as e:
                outcome.error_code, outcome.message = e.code, str(e)[:200]
            except Exception as e:  # whatever an extractor does, the run ends with an entry
                outcome.error_code, outcome.message = "unknown", f"{type(e).__name__}: {str(e)[:200]}"

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(timeout_seconds)
        if thread.is_alive():
            stop.set()
            self.spark.sparkContext.cancelJobGroup(outcome.run_id)
            thread.join(30)
            outcome.success, outcome.error_code, outcome.message = False, "extractor_runtime_error", f"timeout after {timeout_seconds:g}s"
        self._note(event="end", success=outcome.success, error_code=outcome.error_code, message=outcome.message, nodes=sum(outcome.written.values()), edges=0, **base)
        return outcome
