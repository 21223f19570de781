"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 7 bytes cuts a text where it is -1 modulo the block size; each chunk
gives one of 64 characters. The block size is the smallest 3 * 2^i that should give at most 64
chunks, halved while it gives fewer than 32. A fingerprint is `size:signature:signature2`, where
signature2 is cut at twice the block size. Two fingerprints are compared where block sizes are
equal, or one is twice the other, by the longest common subsequence of the signatures (an edit
distance with insertions and deletions), as 2 * lcs / (len + len), and 0 unless they share a run
of four characters (the shorter one's length, if less).

Cases: null text counts as empty; an empty text has the fingerprint `3::`; equal fingerprints have
likeness 1; texts of any length are hashed whole; rows with equal ids are ordered by a hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import arrow_batches, materialize, partitions, release, text_blocks

SIGNATURE, SMALLEST, WINDOW = 64, 3, 7
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_P = np.uint64(0xFF51AFD7ED558CCD)
_Q = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int):
    if not _powers or len(_powers[0]) < n:
        p, q = np.full(n, _P, np.uint64), np.full(n, _Q, np.uint64)
        p[0] = q[0] = 1
        _powers[:] = [np.multiply.accumulate(p), np.multiply.accumulate(q)]
    return _powers


def rolling(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """32-bit hash of the last 7 bytes at each place (fewer at the beginning of a document)."""
    v = data.astype(np.uint32)
    out = (v + np.uint32(1)) * np.uint32(0x9E3779B1)
    mul = 0x9E3779B1
    for back in range(1, min(WINDOW, len(v))):
        mul = mul * 0x85EBCA6B & 0xFFFFFFFF
        term = (v[:-back] + np.uint32(1)) * np.uint32(mul)
        starts = offs[:-1]
        for i in range(back):  # no bytes of the document before
            at = starts + i - back
            at = at[(at >= 0) & (starts + i < offs[1:])]
            term[at] = 0
        out[back:] ^= term
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    return out


def fingerprint_block(data: np.ndarray, offs: np.ndarray) -> list[str]:
    n = len(offs) - 1
    sizes = np.diff(offs)
    roll = rolling(data, offs)
    p, q = _power_tables(len(data) + 1)
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=pre[1:])
    level = np.zeros(n, np.int64)
    for i in range(48):
        more = sizes > SMALLEST * SIGNATURE << i
        if not more.any():
            break
        level[more] = i + 1

    ends = np.flatnonzero(roll % np.uint32(SMALLEST) == SMALLEST - 1)  # cuts at any level are among these
    doc = np.searchsorted(offs, ends, "right") - 1
    quot = (roll[ends] // np.uint32(SMALLEST)).astype(np.int64)
    # level i cuts where the low i bits of the quotient are all ones
    depth = np.zeros(len(ends), np.int64)
    rest = ~quot & 0xFFFFFFFF
    low = rest & -rest
    depth = np.where(rest == 0, 32, np.log2(np.maximum(low, 1)).astype(np.int64))

    def signatures(rows: np.ndarray, at: np.ndarray) -> dict[int, bytes]:
        want = np.full(n, 99, np.int64)
        want[rows] = at
        keep = depth >= want[doc]
        e, d = ends[keep] + 1, doc[keep]
        tail = np.setdiff1d(rows[sizes[rows] > 0], d[e == offs[d + 1]])  # what is left after the last cut is a chunk
        e, d = np.concatenate([e, offs[tail + 1]]), np.concatenate([d, tail])
        order = np.argsort(e, kind="stable")
        e, d = e[order], d[order]
        s = np.empty_like(e)
        if len(e):
            s[0], s[1:] = offs[d[0]], e[:-1]
            first = np.r_[True, d[1:] != d[:-1]]
            s[first] = offs[d[first]]
        h = (pre[e] - pre[s]) * q[s]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        text = _CHARS[(h >> np.uint64(58)).astype(np.int64)].tobytes()
        lo, hi = np.searchsorted(d, rows, "left"), np.searchsorted(d, rows, "right")
        # at most 64 characters: what is beyond them is one last chunk, whose character stands for all the rest
        return {int(r): text[a:b] if b - a <= SIGNATURE else text[a : a + SIGNATURE - 1] + _fold(text[a + SIGNATURE - 1 : b]) for r, a, b in zip(rows, lo, hi)}

    rows = np.arange(n)
    sig = signatures(rows, level)
    while True:
        short = np.array([r for r in rows if level[r] > 0 and len(sig[r]) < SIGNATURE // 2], np.int64)
        if not len(short):
            break
        level[short] -= 1
        sig |= signatures(short, level[short])
    twice = signatures(rows, level + 1)
    return [f"{SMALLEST << int(level[r])}:{sig[r].decode()}:{twice[r].decode()}" for r in rows]


def _fold(rest: bytes) -> bytes:
    return bytes([int(_CHARS[hashlib.blake2b(rest, digest_size=1).digest()[0] & 63])])


def fingerprint_texts(texts: pa.Array) -> list[str]:
    out: list[str] = []
    for _, _, data, offs in text_blocks(texts):
        out += fingerprint_block(data, offs)
    return out


# ---------------------------------------------------------------- comparison


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], np.int64)
    raw = np.zeros((len(strings), SIGNATURE), np.int64)
    flat = np.frombuffer("".join(strings).encode(), np.uint8)
    table = np.zeros(128, np.int64)
    table[_CHARS] = np.arange(64)
    mask = np.arange(SIGNATURE) < size[:, None]
    raw[mask] = table[flat]
    return raw, size


def _ratio(a: list[str], b: list[str]) -> np.ndarray:
    """2 * lcs / (len + len) for each pair of signatures, bit-parallel over 64-bit words."""
    if not a:
        return np.zeros(0)
    (x, m), (y, n) = _codes(a), _codes(b)
    rows = np.arange(len(a))
    masks = np.zeros((len(a), 64), np.uint64)
    for j in range(SIGNATURE):
        live = j < m
        np.bitwise_or.at(masks, (rows[live], x[live, j]), np.uint64(1) << np.uint64(j))
    v = np.full(len(a), ~np.uint64(0))
    for j in range(SIGNATURE):
        u = v & masks[rows, y[:, j]]
        new = (v + u) | (v - u)
        v = np.where(j < n, new, v)
    width = np.where(m >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(m, 63).astype(np.uint64)) - np.uint64(1))
    lcs = np.bitwise_count(~v & width)
    # a shared run of g characters
    g = np.minimum(4, np.minimum(m, n))
    shared = np.zeros(len(a), bool)
    for k in range(1, 5):
        sel = np.flatnonzero(g == k)
        if not len(sel):
            continue
        w = SIGNATURE - k + 1
        gx = sum(x[sel, i : i + w] << (6 * i) for i in range(k))
        gy = sum(y[sel, i : i + w] << (6 * i) for i in range(k))
        gx[np.arange(w) > (m[sel] - k)[:, None]] = -1
        gy[np.arange(w) > (n[sel] - k)[:, None]] = -2
        both = np.sort(np.concatenate([np.sort(gx, 1) * 2, np.sort(gy, 1) * 2 + 1], 1), 1)
        shared[sel] = ((both[:, 1:] - both[:, :-1] == 1) & (both[:, :-1] % 2 == 0) & (both[:, :-1] >= 0)).any(1)
    total = m + n
    return np.where(shared & (total > 0), 2.0 * lcs / np.maximum(total, 1), 0.0)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of fingerprints, pair by pair, from 0 to 1."""
    p, q = [s.split(":") for s in a], [s.split(":") for s in b]
    out = np.zeros(len(a))
    for own, other, pick in ((1, 1, lambda i, j: i == j), (2, 2, lambda i, j: i == j), (1, 2, lambda i, j: i == 2 * j), (2, 1, lambda i, j: 2 * i == j)):
        sel = [k for k in range(len(a)) if pick(int(p[k][0]), int(q[k][0]))]
        if sel:
            out[sel] = np.maximum(out[sel], _ratio([p[k][own] for k in sel], [q[k][other] for k in sel]))
    out[[k for k in range(len(a)) if a[k] == b[k]]] = 1.0
    return out


# ---------------------------------------------------------------- operators


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a column that holds the fingerprint of its text."""
    schema = docs.withColumn(out, F.lit("")).schema

    def run(batches):
        for batch in batches:
            col = pa.array(fingerprint_texts(batch.column(text)), pa.string())
            names = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), col], [*names, out])

    return docs.drop(out).mapInArrow(run, docs.drop(out).withColumn(out, F.lit("")).schema if out in docs.columns else schema)


def _compared(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
    own = fingerprint_texts(pa.array([*texts, following[-1]], pa.large_string()))
    changed = fingerprint_texts(pa.array(edited, pa.large_string()))
    nxt = own[1:]
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
        "fingerprint": own[:-1], "edited_fingerprint": changed,
        "near_edited": likeness(own[:-1], changed).tolist(), "near_next": likeness(own[:-1], nxt).tolist(),
    }


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, the text with its second half taken from the next document in
    descending doc_id (after the last comes the first), and compare both, and the next, with it.

    The texts are range-partitioned by doc_id once; a partition hands only the text of its first
    document on, to be paired with the last of the partition before.
    """
    arrow_batches(docs.sparkSession)
    spark = docs.sparkSession
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]  # the range sample on the driver holds no text
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held, first, size = [], None, 0

        def flush():
            ids, texts = [x[0] for x in held], [x[1] for x in held]
            out = _compared(ids[:-1], texts[:-1], texts[1:])
            k = len(ids) - 1
            return pa.RecordBatch.from_pydict({**out, "pid": [pid] * k, "head": [None] * k, "tail": [None] * k}, schema=EDGE)

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                first = first if first is not None else (i, t)
                held.append((i, t))
                size += len(t)
                if size > 1 << 20 and len(held) > 1:
                    yield flush()
                    held[:], size = held[-1:], len(t)
        if len(held) > 1:
            yield flush()
        if first is not None:
            none = {f: [None] for f in EDGE.names}
            yield pa.RecordBatch.from_pydict({**none, "doc_id": [held[-1][0]], "pid": [pid], "head": [first[1]], "tail": [held[-1][1]]}, schema=EDGE)

    edge_schema = RESULT + ", pid int, head string, tail string"
    EDGE = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("pid", pa.int32()), ("head", pa.string()), ("tail", pa.string())])
    done = materialize(rows.mapInArrow(run, edge_schema), "ctph")
    inner = done.where("head is null").select(*[f.split()[0] for f in RESULT.split(", ")])
    edges = done.where("head is not null")
    pids = sorted(r[0] for r in edges.select("pid").distinct().collect())  # one number for each partition
    if not pids:
        return inner
    follows = spark.createDataFrame([(p, pids[(i + 1) % len(pids)]) for i, p in enumerate(pids)], "pid int, after int")
    pairs = edges.select("doc_id", "tail", "pid").join(follows, "pid").join(
        edges.select(F.col("pid").alias("after"), "head"), "after"
    ).select("doc_id", "tail", "head").repartition(partitions(spark))

    def last(frames):
        for pdf in frames:
            for i, t, f in zip(pdf["doc_id"], pdf["tail"], pdf["head"]):
                yield pd.DataFrame(_compared([None if pd.isna(i) else int(i)], [t], [f]))

    return inner.union(pairs.mapInPandas(last, RESULT))
