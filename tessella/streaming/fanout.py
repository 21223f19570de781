"""Opt-outs from a stream into a table of preferences, once for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.versions import VersionedTable


def opt_out_merge(target: VersionedTable, key: str, at: str):
    """A function for foreachBatch: every preference of a key that stopped is opted out, and a history row (with `changed_at`,
    the time of the key's first stop in the batch, and `batch_id`) is added for each that changed. Parts of the table:
    `preferences` (with key and status) and `history`. The id of the batch is committed with the rows, so a batch that
    is played again changes nothing. Stops with a null key stop nobody."""

    def merge(stops: DataFrame, batch: int) -> None:
        base = target.version()
        done = target.facts(base)
        if done["facts"].get("batch_id", -1) >= batch:
            return
        preferences = target.read("preferences", base)
        gone = stops.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("_at"))
        both = preferences.join(gone, key, "left")
        hit = F.col("_at").isNotNull() & (F.coalesce("status", F.lit("")) != "opted_out")
        after = both.withColumn("status", F.when(hit, "opted_out").otherwise(F.col("status"))).select(*preferences.columns)
        rows = both.where(hit).withColumn("status", F.lit("opted_out")).select(*preferences.columns, F.col("_at").alias("changed_at"), F.lit(batch).cast("long").alias("batch_id"))
        history = target.read("history", base).unionByName(rows) if "history" in done["parts"] else rows
        target.replace({"preferences": after, "history": history}, base, batch_id=batch)

    return merge
