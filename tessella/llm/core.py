"""Shared pieces of the training-data operators.

Text is handled as the raw UTF-8 buffers of Arrow columns: a batch of documents is one byte
array plus offsets, and words, shingles and windows are index arrays over it, so the Python
side never builds one object per word.
"""

from __future__ import annotations

import hashlib
import os
import secrets
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single document is one step.
BLOCK_BYTES = 1 << 20
#: White space of the word rule `[^\x20\x09-\x0D]+`.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Mask of the first k bytes of a word of 8; bytes from which on a span is digested whole.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_SPAN = 4096
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session
    gets one here; on a cluster, whose machines share no local folder, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return str(jdir.get())
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = f"/tmp/tessella-checkpoints-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(where)
    return where


#: With this setting Spark removes the shuffle files of a statement when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession):
    """Shuffles of the statements inside are removed as each ends: what they write is read from its table."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    with own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(df: DataFrame) -> None:
    """Delete a table written by materialize() once nothing lazy reads it any more."""
    path = getattr(df, "_tessella_path", None)
    if path:
        remove_path(df.sparkSession, path)


def table_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table written by materialize()."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df._tessella_path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def join_sized(left: DataFrame, right: DataFrame, on, how: str, bound: int = 8 << 20) -> DataFrame:
    """Join with right broadcast if its written size is below bound bytes, else by shuffle."""
    if getattr(right, "_tessella_path", None) and table_bytes(right) <= bound:
        return left.join(F.broadcast(right), on, how)
    return left.join(right, on, how)


#: Variable with the key of hashes whose equality decides; all tasks of an application have the same.
_KEY = "TESSELLA_HASH_KEY"


def run_key() -> int:
    """The application's random key. A hash that begins with it can't be made to collide by who wrote a text before."""
    return int(os.environ.get(_KEY, "0"), 16)


def arrow_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Hold batches of rows that go to Python at a few MB, whatever the length of their texts. The setting is
    read when a lazy result is planned, so it stays for the session."""
    known = spark.sparkContext.environment  # of the Python workers of functions made from now on
    os.environ[_KEY] = known.setdefault(_KEY, os.environ.get(_KEY) or secrets.token_hex(8))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > limit:
        spark.conf.set(key, str(limit))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text as arrays


def text_blocks(column: pa.Array):
    """Yield (first row, last row, bytes, offsets) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses, for hashes that only choose places."""
    size = max(BLOCK_BYTES, n) + 1
    if size not in _tables:
        _tables.clear()
        p = np.full(size, _BASE, np.uint64)
        q = np.full(size, _U(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        p[0] = q[0] = 1
        _tables[size] = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes: mix() chained over its words of 8 bytes, length and key first. No sum over
    powers, whose values agree for some texts whatever the base. Spans above LONG_SPAN are digested whole. With key 0 spans of
    equal value can be written down; where equal values decide, key is run_key()."""
    chunks = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    size = end - start
    h = mix(mix(size.astype(np.uint64) + _BASE) ^ _U(key)) if key else mix(size.astype(np.uint64) + _BASE)
    live, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] ^ (chunks[start[live] + at] & _FIRST[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(size > LONG_SPAN):
        h[k] = np.frombuffer(hashlib.blake2b(data[start[k] : end[k]], digest_size=8, key=key.to_bytes(8, "little") if key else b"").digest(), "<u8")[0]
    return h


def run_hash(symbols: np.ndarray, start: np.ndarray, count: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hash of each run of `count` symbols from start, chained like span_hash()."""
    h = mix(mix(count.astype(np.uint64) + _BASE) ^ _U(key)) if key else mix(count.astype(np.uint64) + _BASE)
    live, at = np.flatnonzero(count > 0), 0
    while len(live):
        h[live] = mix(h[live] ^ symbols[start[live] + at])
        at += 1
        live = live[count[live] > at]
    return h


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, key: int = 0):
    """(start, end, row) of every word of the block, and the 64-bit hash of each word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | cut[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(offs, s, "right") - 1
    return s, e, row, span_hash(_LOWER[data] if lower else data, s, e, key)


def windows(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of k consecutive symbols of h (len(h)-k+1 values)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed * int(_BASE) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(k):
        out = mix(out ^ h[j : j + n])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span, cur = 1, x
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < w:
        cur = np.minimum(cur[: len(cur) - (w - span)], cur[w - span :])
    return cur


def blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id per node, from edges (a long, b long); nodes are those with an edge.

    Alternates large-star and small-star steps: each replaces every edge by one to the smallest
    neighbour, so the edge count never grows and long chains halve each round. State is a table
    in the shared folder; hubs are pre-aggregated by the partial min and split by AQE's skew join.
    """
    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    for _ in range(rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = materialize(low, "cc")  # a table of its own, so that a hub's rows can be split in the join
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        )
        large = materialize(large.distinct(), "cc")
        release(low)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(
            small.where("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct(), "cc"
        )
        release(large)
        # done when it is a star forest: no centre is itself attached to something
        attached = nxt.select(F.col("a").alias("b")).join(nxt, "b", "left_semi").limit(1).count()
        doubled = nxt.groupBy("a").count().where("count > 1").limit(1).count() if not attached else 1
        release(cur)
        cur = nxt
        if not attached and not doubled:
            break
    else:
        raise RuntimeError("components did not settle")
    out = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


# ---------------------------------------------------------------- groups inside a sorted partition


def whole_groups(batches, keys: list[str], rows: int = 20_000):
    """Tables that hold whole groups, from batches of a partition sorted by keys (at least about `rows`
    rows each, more where one group has more), with the first row of each group."""
    held: list[pa.RecordBatch] = []
    n = 0

    def edges(table):
        cols = [np.asarray(table.column(k)) for k in keys]
        change = np.zeros(len(cols[0]), bool)
        change[:1] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            at = edges(table)
            if at[-1]:  # all but the last group, which may go on
                yield table.slice(0, at[-1]), at[:-1]
                rest = table.slice(at[-1])
                held, n = rest.to_batches(), rest.num_rows
            else:
                held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, edges(table)


def split_blocks(members: DataFrame, size: str, ident: str, block: int) -> DataFrame:
    """Rows of groups of `size` members with lo, hi and block: a group of more than `block` members is cut
    into blocks by ident, and each pair of blocks (lo <= hi) is a group that meets once."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64(ident), blocks).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"lo": F.least("block", "_other"), "hi": F.greatest("block", "_other")}).drop("_other")


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n indices is connected to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            break
    return label
