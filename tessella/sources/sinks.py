"""Sinks: table writes that a failed job leaves as they were."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p, jvm


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, then put it in its place by two renames. No reader sees a half-written table;
    one that comes between the renames finds none. If the second fails, the old table comes back."""
    tmp, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(tmp)
    fs, p, jvm = _fs(df, path)
    before = jvm.org.apache.hadoop.fs.Path(old)
    had = fs.exists(p)
    if had and not fs.rename(p, before):
        raise OSError(f"can't move {path}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(tmp), p):
        if had:
            fs.rename(before, p)
        raise OSError(f"can't move {tmp}")
    if had:
        fs.delete(before, True)


def write_both(df: DataFrame, primary: str, secondary: str) -> None:
    """The same rows to two tables, computed once."""
    replace_table(df, primary)
    replace_table(df.sparkSession.read.parquet(primary), secondary)


def write_batches(df: DataFrame, send, size: int = 100) -> None:
    """Hand batches of rows to send(list of rows) on the executors; a refused row fails the task, which is tried again."""

    def run(rows):
        batch = []
        for r in rows:
            batch.append(r)
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)


def append_journal(df: DataFrame, path: str) -> None:
    """One JSON object a line, appended."""
    df.write.mode("append").json(path)


def csv_lines(df: DataFrame, quoted: list[str]) -> DataFrame:
    """One column `line`: the columns separated by commas, the named ones in quotes with quotes doubled."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) if c in quoted else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("line"))


def materialise_view(df: DataFrame, path: str, by: str, whole: bool = False) -> None:
    """A folder for each value of `by`; those that are written are replaced. The others stay, or are
    deleted if df is the whole view."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy(by).parquet(path)


def backup(df: DataFrame, path: str, label: str) -> str:
    """A copy of the table under a label, unless that backup is there."""
    target = f"{path}.backup-{label}"
    fs, p, jvm = _fs(df, target)
    if not fs.exists(p):
        df.write.parquet(target)
    return target


def markdown_report(rows: DataFrame, by: str, order: list[str], heading: str, body: str) -> DataFrame:
    """by, report: a section of heading and text for each row of a group, in order."""
    part = F.concat(F.lit("## "), F.col(heading), F.lit("\n\n"), F.col(body))
    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, part.alias("_p")))).alias("_l"))
    return g.select(by, F.concat(F.lit("# "), F.col(by).cast("string"), F.lit("\n\n"), F.array_join(F.transform("_l", lambda x: x["_p"]), "\n\n")).alias("report"))


def audited(df: DataFrame, step: str, *metrics):
    """df with named metrics that Spark reports when it runs, and the observation to read them from."""
    from pyspark.sql import Observation

    seen = Observation(step)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), seen
