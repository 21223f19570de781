"""Audit rows of steps, failures, retries and micro-batches."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tessella.sources.audit import MOST_PAUSE, Audit


def test_a_step_is_told_with_its_observed_metrics(spark, tmp_path):
    audit = Audit(spark, f"{tmp_path}/audit", "a")
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    audit.step("save", df, lambda x: x.write.parquet(f"{tmp_path}/t"), F.max("v").alias("most"), F.max(F.lit("text")).alias("text"))
    audit.step("empty", df.limit(0), lambda x: x.write.parquet(f"{tmp_path}/e"), F.max("v").alias("most"))
    rows = {r.step: r for r in audit.rows().collect()}
    assert rows["save"].metrics == {"rows": 100.0, "most": 6.0} and rows["empty"].metrics == {"rows": 0.0}
    assert all(r.status == "success" and r.run == "a" and r.error is None and r.duration_ms >= 0 for r in rows.values())
    assert Audit(spark, f"{tmp_path}/audit", "b").rows().count() == 0


def test_a_failing_step_is_tried_again_and_told(spark, tmp_path):
    audit, tries, pauses = Audit(spark, f"{tmp_path}/audit"), [], []

    def act(df):
        tries.append(1)
        if len(tries) < 5:
            raise OSError("gone\nmore")
        return df.count()

    assert audit.step("flaky", spark.range(3), act, attempts=5, pause=pauses.append) == 3
    assert pauses == [1.0, 2.0, 4.0, MOST_PAUSE]
    rows = audit.rows().orderBy("attempt").collect()
    assert [(r.status, r.attempt, r.error) for r in rows] == [("failed", k, "gone") for k in (1, 2, 3, 4)] + [("success", 5, None)]

    def never(df):
        raise ValueError

    with pytest.raises(ValueError):
        audit.step("never", spark.range(3), never, attempts=2, pause=pauses.append)
    assert audit.rows().where("step = 'never' and status = 'failed'").count() == 2


def test_micro_batches_are_told(spark, tmp_path):
    audit = Audit(spark, f"{tmp_path}/audit", "s")
    heard = audit.listener("counted")
    spark.streams.addListener(heard)
    try:
        for k in range(2):
            spark.range(k * 10, k * 10 + 5 + k).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").observe("told", F.sum("id").alias("total"))
            query = stream.writeStream.queryName("counted").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
            query.awaitTermination(120)
        for _ in range(60):
            rows = audit.rows().where("metrics.input_rows > 0").collect() if (tmp_path / "audit").exists() else []
            if len(rows) == 2:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(heard)
    assert sorted((r.metrics["batch_id"], r.metrics["input_rows"], r.metrics["total"]) for r in rows) == [(0.0, 5.0, 10.0), (1.0, 6.0, 75.0)]
    assert {r.step for r in rows} == {"counted"}
