"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users. The result has one row per (conversation, perspective,
turn): the rendered segment, where it starts in the rendered dialogue, and the span that is
trained on (the assistant's words and end marker; null for users). Segments in order of `start`
are the dialogue; a conversation of any length is never gathered in one task.

Start offsets are prefix sums in two levels: rows are range-partitioned by (conversation,
perspective, turn) and summed along each sorted partition; a dialogue that goes on over several
partitions adds the totals of those before. Texts are shuffled for the join and the range only.

Cases: a null role is the speaker `unknown`; null text is empty; null turns come last; equal turns
are ordered by speaker, then the text's md5; repeated rows each count; a marker inside a text is broken up
(`<|` becomes `< |`) so it can't end a turn; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import arrow_batches, materialize, partitions

END = "<|end|>"


def _running(batches):
    """Adds pid and own: the sizes of the rows of the same dialogue before, in a sorted partition."""
    from pyspark import TaskContext

    pid, last, carried = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column("size").to_numpy(zero_copy_only=False)
        keys = list(zip(batch.column("conv_id").to_pylist(), batch.column("perspective").to_pylist()))
        new = np.array([k != (last if i == 0 else keys[i - 1]) for i, k in enumerate(keys)])
        total = np.cumsum(size)
        begin = np.flatnonzero(np.r_[True, new[1:]])
        group = np.cumsum(np.r_[True, new[1:]]) - 1
        base = np.r_[0, total][begin]
        base[0] -= 0 if new[0] else carried
        own = total - size - base[group]
        last, carried = keys[-1], int(own[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(own)], [*batch.schema.names, "pid", "own"])


def perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, start, mask_start, mask_end."""
    spark = conversations.sparkSession
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    who = turns.select(F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), "speaker", F.lit("|>\n")))
    rows = (
        turns.join(who, turns.conv_id.eqNullSafe(who._c))
        .drop("_c")
        .withColumns({"head": F.length(head), "segment": F.concat(head, "text", F.lit(END + "\n")), "mine": mine})
    )
    rows = rows.withColumns({"size": F.length("segment").cast("long"), "md5": F.md5("text")}).drop("text")
    order = ["conv_id", "perspective", F.asc_nulls_last("turn"), "speaker", "md5"]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("md5")
    arrow_batches(spark)
    rows = materialize(rows.mapInArrow(_running, rows.withColumns({"pid": F.lit(0), "own": F.lit(0).cast("long")}).schema), "chat")
    # only a dialogue that goes on from one partition to the next has a base: at most two rows for each partition
    key = ["conv_id", "perspective"]
    totals = rows.groupBy("pid", *key).agg(F.sum("size").alias("t"))
    several = totals.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_w"))
    long = totals.join(F.broadcast(several), totals.conv_id.eqNullSafe(several._c) & (totals.perspective == several._w))
    before = Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = long.select(F.col("pid").alias("_p"), "_c", "_w", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_base"))
    out = rows.join(
        F.broadcast(bases), (rows.pid == bases._p) & rows.conv_id.eqNullSafe(bases._c) & (rows.perspective == bases._w), "left"
    )
    start = F.coalesce("_base", F.lit(0)) + F.col("own")
    return out.select(
        "conv_id", "perspective", "turn", "speaker", F.when(F.col("mine"), "assistant").otherwise("user").alias("role"),
        "segment", start.alias("start"), F.when(F.col("mine"), start + F.col("head")).alias("mask_start"),
        F.when(F.col("mine"), start + F.col("size") - 1).alias("mask_end"),
    )
