"""Steps of a job and micro-batches of a stream as rows of an audit table: status, time, and the metrics Spark observes.

Metrics are computed by the statement that does the step's work (`DataFrame.observe`), not by a second pass. A row is
appended when its step ends, also when it fails. Rows are small and as many as steps; the table is JSON lines in a folder
that driver and executors share.

Cases: a step without rows has metrics of 0 or null; a step that fails has status `failed`, its error's first line and no
metrics, and raises on; a metric's name that the table does not know is one more key of the map `metrics`.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, step string, status string, attempt int, started timestamp, duration_ms long, metrics map<string,double>, error string"
#: Longest pause between two attempts, in seconds.
MOST_PAUSE = 5.0


def _numbers(told: dict) -> dict[str, float]:
    """The numeric metrics of an observation; others are no figures and stay out."""
    return {k: float(v) for k, v in told.items() if v is not None and not isinstance(v, (str, bytes)) and hasattr(v, "__float__")}


class Audit:
    """The audit table at path; `run` names the job that its rows belong to."""

    def __init__(self, spark: SparkSession, path: str, run: str | None = None):
        self.spark, self.path, self.run = spark, path, run or uuid.uuid4().hex

    def write(self, step: str, status: str, attempt: int, started: datetime, duration_ms: int, metrics: dict | None = None, error: str | None = None) -> None:
        row = (self.run, step, status, attempt, started, duration_ms, metrics or {}, error)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def rows(self) -> DataFrame:
        """The rows of this run."""
        return self.spark.read.schema(SCHEMA).json(self.path).where(F.col("run") == self.run)

    def step(self, name: str, df: DataFrame, act: Callable[[DataFrame], object], *metrics: Column, attempts: int = 1, pause: Callable[[float], None] = time.sleep):
        """act(df) with the number of its rows (`rows`) and `metrics` observed; a row for each attempt. act must run df whole and can be
        repeated; between attempts there are 1, 2, 4, ... seconds, MOST_PAUSE at most."""
        for attempt in range(1, attempts + 1):
            seen = Observation(f"{name}-{uuid.uuid4().hex}")
            started, clock = datetime.now(timezone.utc), time.perf_counter()
            try:
                out = act(df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics))
            except Exception as e:
                self.write(name, "failed", attempt, started, round((time.perf_counter() - clock) * 1000), error=(str(e).splitlines() or [""])[0][:1000])
                if attempt == attempts:
                    raise
                pause(min(2.0 ** (attempt - 1), MOST_PAUSE))
            else:
                took = round((time.perf_counter() - clock) * 1000)
                self.write(name, "success", attempt, started, took, _numbers(seen.get))
                return out

    def listener(self, name: str) -> StreamingQueryListener:
        """For spark.streams.addListener: a row for each micro-batch of the query called `name` (step `name`, metrics batch_id,
        input_rows and those observed in the query), and one when it ends by an error."""
        audit = self

        class Listener(StreamingQueryListener):
            ident = None

            def onQueryStarted(self, event):
                if event.name == name:
                    self.ident = event.id

            def onQueryProgress(self, event):
                p = event.progress
                if p.name != name:
                    return
                seen = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items()}
                figures = {"batch_id": float(p.batchId), "input_rows": float(p.numInputRows)} | _numbers(seen)
                at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
                audit.write(name, "success", 1, at, int(p.durationMs.get("triggerExecution", 0)), figures)

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                if event.id == self.ident and event.exception:
                    audit.write(name, "failed", 1, datetime.now(timezone.utc), 0, error=event.exception.splitlines()[0][:1000])

        return Listener()
