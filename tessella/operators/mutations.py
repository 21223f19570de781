"""Table maintenance: every mutation is a DataFrame of the new table state, to be written by the caller
or by the sinks in tessella.sources.sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import keep_last


def replace_groups(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """All rows of existing whose key is in the batch go, then the batch comes. Repeating it changes nothing."""
    return existing.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def upsert(existing: DataFrame, batch: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of the batch replace those of equal key; of several in the batch the last by order stays."""
    batch = keep_last(batch, key, order) if order else batch.dropDuplicates(key)
    return existing.join(batch.select(*key), key, "left_anti").unionByName(batch.select(*existing.columns))


def append_new(existing: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Append rows whose key is not there; a null key is always new."""
    complete = F.lit(True)
    for k in key:
        complete = complete & F.col(k).isNotNull()
    keyed = batch.where(complete).dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(keyed.select(*existing.columns)).unionByName(batch.where(~complete))


def find_or_create(existing: DataFrame, seen: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key of both; a column changes only to a value that is told and different. Adds action."""
    told = seen.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_seen"))
    both = existing.withColumn("_old", F.lit(True)).join(told, key, "full_outer")
    change = F.lit(False)
    for c in columns:
        change = change | (F.col(f"_new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_new_{c}")))
    action = F.when(F.col("_old").isNull(), "created").when(change, "updated").otherwise("kept")
    return both.select(key, *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns], action.alias("action"))


def patch(existing: DataFrame, patches: DataFrame, key: str, columns: list[str], merged: str | None = None) -> DataFrame:
    """Columns of a patch that are not null replace; a map column is merged key by key."""
    names = [*columns, *([merged] if merged else [])]
    told = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in names])
    out = existing.join(told, key, "left").withColumns({c: F.coalesce(f"_p_{c}", c) for c in columns})
    if merged:
        new = F.col(f"_p_{merged}")
        kept = F.map_filter(F.col(merged), lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
        out = out.withColumn(merged, F.when(new.isNull(), F.col(merged)).otherwise(F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), new)))
    return out.select(*existing.columns)


def desired_state(current: DataFrame, desired: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    """key, action, status: activate what is desired and not active, keep what is both, revoke the rest."""
    a = current.select(*key, F.col(status).alias("_was"))
    b = desired.select(*key).distinct().withColumn("_want", F.lit(True))
    both = a.join(b, key, "full_outer")
    active = F.coalesce(F.col("_was") == "active", F.lit(False))
    action = (
        F.when(F.col("_want") & active, "keep").when(F.col("_want"), "activate").when(active, "revoke").otherwise("none")
    )
    return both.select(*key, action.alias("action"), F.when(F.col("_want"), "active").otherwise("revoked").alias("status"))


def history_rows(changes: DataFrame, key: list[str], at: str) -> DataFrame:
    """A history row for each change."""
    return changes.where("action in ('activate', 'revoke')").select(*key, "action", "status", F.lit(at).cast("timestamp").alias("changed_at"))


def delete_where_in(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the deleted ones: applied to each dependent table, a cascade."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def newest_ring(jobs: DataFrame, key: str, order: str, size: int = 20, by: str | None = None) -> DataFrame:
    """The newest row of each key, and of those the newest `size` (of each group, if there are groups)."""
    latest = keep_last(jobs, [key], [order])
    if by is None:
        return latest.orderBy(F.desc(order), F.asc(key)).limit(size)
    w = Window.partitionBy(by).orderBy(F.desc(order), F.asc(key))
    return latest.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def orphans(files: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Files that no active row names."""
    return files.join(active.select(key), key, "left_anti")


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has: what a unique constraint would refuse."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
