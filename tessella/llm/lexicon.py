"""Work that is done once for each distinct value of a corpus, whatever its number of occurrences.

A block of documents is a dictionary of values (words, id pairs) and codes into it. Dictionaries go to
buckets by the hash of the value, packed as one row for each block and bucket; a bucket is one task, reads
its rows as a stream and answers each in the order it asked. Codes stay with their block. So what is
shuffled is pre-aggregated by block, and a value that every document has costs one entry for each block.

The hash only chooses a bucket; values are compared as values.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import BLOCK_BYTES, own_shuffles, partitions, remove_path, shared_dir

#: Bytes of text of a block, about; of text behind a bucket, about.
BLOCK, BUCKET = 12 << 20, 256 << 20
#: White space, letters, numbers of the pattern that splits text, in this order; all else is a fourth class.
CLASSES = (r"\s", r"\p{L}", r"\p{N}")
#: What follows an apostrophe in a part of its own (fixed values of the pattern).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


# ---------------------------------------------------------------- packed columns


def pack_ints(x: np.ndarray) -> bytes:
    """Integers from 0 on, as compressed planes of bytes."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<QB", len(x), width) + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def unpack_ints(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<QB", blob)
    out = np.zeros((n, 8), np.uint8)
    if n:
        raw = pa.decompress(blob[9:], n * width, "zstd", asbytes=True)
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<i8")[:, 0]


def pack_many(*columns: np.ndarray) -> bytes:
    parts = [pack_ints(c) for c in columns]
    return b"".join(struct.pack("<Q", len(p)) + p for p in parts)


def unpack_many(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        (n,) = struct.unpack_from("<Q", blob, at)
        out.append(unpack_ints(blob[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of runs of count[i] from start[i], one run after the other."""
    at = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - at, count)


def spans(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Values data[offsets[i]:offsets[i+1]] as a binary array, without a copy of the data."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first : int(offsets[-1]) if len(offsets) else 0], offsets - first


def pack_words(words: pa.Array) -> bytes:
    data, offsets = flat_bytes(words)
    head = pack_ints(np.diff(offsets))
    return struct.pack("<QQ", len(head), len(data)) + head + pa.compress(data.tobytes(), "zstd", asbytes=True)


def unpack_words(blob: bytes) -> pa.Array:
    head, size = struct.unpack_from("<QQ", blob)
    counts = unpack_ints(blob[16 : 16 + head])
    data = np.frombuffer(pa.decompress(blob[16 + head :], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    return spans(data, np.r_[0, np.cumsum(counts)])


# ---------------------------------------------------------------- parts of text


@cache
def _class_of() -> np.ndarray:
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, len(CLASSES), np.uint8)
    for k, pattern in enumerate(CLASSES):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = k
    return out


def _follows(points: np.ndarray, at: np.ndarray, word: str) -> np.ndarray:
    out = np.ones(len(at), bool)
    for k, c in enumerate(word):
        out &= points[np.minimum(at + k, len(points) - 1)] == ord(c)
    return out


def pattern_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """_pattern_cuts(), for about BLOCK_BYTES of texts at a time."""
    out, i, n = [np.zeros(1, np.int64)], 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1))
        out.append(offsets[i] + _pattern_cuts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1:])
        i = j
    return np.concatenate(out)


def _pattern_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which the matches of public_tokenizers.PATTERN start in texts data[offsets[i]:offsets[i+1]],
    and the end: runs of one class of code points; a run after white space takes its last blank with it (other white
    space before it stands alone); an apostrophe that begins a run takes s, t, re, ve, m, ll, d that follow."""
    if not len(data):
        return np.zeros(1, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a code point
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    first = np.searchsorted(lead, offsets)  # of each text, in code points
    kind, n = _class_of()[points], len(points)
    head = np.zeros(n + 1, bool)
    head[first] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    solid = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0) & ~head[1:n]) + 1  # after white space of its text
    start[solid - 1] = True
    start[solid[points[solid - 1] == 32]] = False
    quote = np.flatnonzero(start & (points == ord("'")))
    if len(quote):
        end = first[np.searchsorted(first, quote, "right")]
        for word in CONTRACTIONS:
            hit = quote[(quote + len(word) < end) & _follows(points, quote + 1, word)]
            start[hit + 1] = False
            after = hit + 1 + len(word)
            start[after[after < n]] = True
    return np.r_[lead[np.flatnonzero(start)], len(data)]


def blank_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets at which runs of blanks start, those of texts, and the end: no piece of a vocabulary whose blanks
    stand only in front goes over such a place."""
    if not len(data):
        return np.zeros(1, np.int64)
    start = np.zeros(len(data) + 1, bool)
    start[:-1] = data == 32
    start[1:-1] &= data[:-1] != 32
    start[offsets] = True
    return np.flatnonzero(start)


# ---------------------------------------------------------------- blocks and buckets


def blocks_of(batches, text: int = 1, size: int = BLOCK) -> Iterator[pa.Table]:
    """Batches of rows, joined to tables of about size bytes in the text column."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.column(text).nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def block_number() -> Iterator[int]:
    """Numbers of the blocks of this task that no other task has; a task that is run again has the same."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 33
    k = 0
    while True:
        yield base + k
        k += 1


def bucket_count(docs: DataFrame, text: str = "text", bucket: int = BUCKET) -> int:
    """Buckets for the distinct values of a corpus: by its bytes, so that one task holds what it has met."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-int(size) // bucket))


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order of the entries by bucket, [(bucket, first, last)])."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(n + 1))
    return order, [(b, int(edge[b]), int(edge[b + 1])) for b in range(n) if edge[b] < edge[b + 1]]


def sent_array(rows: list[list[tuple[int, bytes]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("data", pa.binary())]))
    return pa.array([[{"bucket": b, "data": d} for b, d in row] for row in rows], kind)


def write_bucketed(df: DataFrame, key: str, tag: str) -> tuple[DataFrame, str]:
    """(df as a table in the shared folder, bucketed and sorted by key, its name): joins by key read it where it is."""
    spark, name = df.sparkSession, f"tessella_{tag}_{uuid.uuid4().hex}"
    with own_shuffles(spark):
        df.write.bucketBy(partitions(spark), key).sortBy(key).option("path", _place(spark, name)).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}"


def drop_bucketed(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove_path(spark, _place(spark, name))


def to_buckets(blocks: DataFrame, column: str, n: int) -> DataFrame:
    """block, bucket, data of every packed dictionary; the partition of a row is its bucket."""
    rows = blocks.select("block", F.explode(column).alias("_s")).select("block", "_s.bucket", "_s.data")
    return rows.repartitionById(n, F.col("bucket"))


def to_blocks(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """blocks (read where they are, if bucketed by block) with `answers`, the packed answers of all buckets by bucket (a block's own dictionary bounds them)."""
    told = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias("answers"))
    return blocks.join(told, "block", "left")
