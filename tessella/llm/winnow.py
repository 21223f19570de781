"""Winnowed segments: an exact filter for long repeated windows.

A text is a sequence of symbols (bytes, or word hashes); a window is W consecutive symbols of one
document. Each window selects an anchor: of its k-symbol shingles the one of least hash, the first
of those. Windows in a row with the same anchor place form a segment, which is W + (windows - 1)
symbols of content. Equal windows select equal shingles at equal places, so equal windows are
always in segments of equal anchor hash, and segments of equal content hold equal windows in
equal places. Per document there are about 2 / (W - k + 2) segments for each symbol, and only they
(anchor, content digest, document, place), not the windows, are exchanged:

* all but the first segment of a content are repeated whole;
* of an anchor with several contents, the first segment of each content is `open`: its windows may
  or may not be repeated in the others, and the operator compares just these window by window;
* the first and only content of an anchor is not repeated.

Hot contents are pre-aggregated where they are read (a task sends one segment of each content), so
they arrive once for each task. Hot anchors, which stand in many different contents, are dealt by
content instead (see hot_anchors). Digests are 64 bits each for anchor and content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import arrow_batches, mix, partitions, powers, run_hash, run_key, sliding_min, span_hash, text_blocks, words

#: Segments that a task holds before it sends them on.
SEND = 400_000
#: An anchor is hot from this many sampled documents on and this share of them (1 in HOT_SHARE); one document
#: in HINT_OF is sampled; HOT_MOST of the hottest are dealt by content.
HOT_LEAST, HOT_SHARE, HINT_OF, HOT_MOST = 50, 200, 64, 1000


@dataclass(frozen=True)
class Windows:
    """W symbols a window, k a shingle; words or bytes; whether an earlier place in the same document counts."""

    size: int
    shingle: int
    words: bool
    within: bool

    def symbols(self, data: np.ndarray, offs: np.ndarray):
        """(symbol hashes, row of each symbol, first symbol of each row)."""
        n = len(offs) - 1
        if self.words:
            _, _, row, sym = words(data, offs, key=run_key())
            return sym, row, np.searchsorted(row, np.arange(n + 1))
        return mix(data.astype(np.uint64) + np.uint64(77)), np.repeat(np.arange(n), np.diff(offs)), offs


FIELDS = [("h", np.uint64), ("s", np.uint64), ("doc", np.int64), ("start", np.int32), ("n", np.uint8)]


def segments(spec: Windows, data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """row, start, n, h, s of the segments of a block."""
    sym, row, first = spec.symbols(data, offs)
    W, k = spec.size, spec.shingle
    if len(sym) < W:
        return {f: np.zeros(0, t) for f, t in (*FIELDS, ("row", np.int64))}
    up, down = powers(len(sym))
    pre = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(sym * up[: len(sym)], out=pre[1:])
    g = pre[k:] - pre[:-k]
    g *= down[: len(g)]
    g = mix(g)  # only chooses anchors: different shingles of equal hash share a group, no more
    # hash and place in one number: the least is the first of the least
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    at = (sliding_min(key, W - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = len(at)
    st = np.flatnonzero(row[W - 1 : W - 1 + n] == row[:n])
    at = at[st]
    if not len(st):
        return {f: np.zeros(0, t) for f, t in (*FIELDS, ("row", np.int64))}
    new = np.r_[True, (at[1:] != at[:-1]) | (st[1:] != st[:-1] + 1)]
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(st)]
    begin, size = st[a], st[b - 1] + W - st[a]
    s = run_hash(sym, begin, size, run_key()) if spec.words else span_hash(data, begin, begin + size, run_key())
    r = row[st[a]]
    return {"h": g[at[a]], "s": s, "row": r, "start": (st[a] - first[r]).astype(np.int32), "n": (b - a).astype(np.uint8)}


def order_of(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    o = np.lexsort((x["start"], x["doc"], x["s"], x["h"]))
    return {k: v[o] for k, v in x.items()}


def new_content(x: dict[str, np.ndarray]) -> np.ndarray:
    """Of sorted segments: where a content begins."""
    return np.r_[True, (x["h"][1:] != x["h"][:-1]) | (x["s"][1:] != x["s"][:-1])] if len(x["h"]) else np.zeros(0, bool)


def later(spec: Windows, x: dict[str, np.ndarray], lead: np.ndarray) -> np.ndarray:
    """Whether each segment comes after the first of its content (of repeated rows, the same place does not)."""
    doc, first_doc = x["doc"], x["doc"][lead]
    if not spec.within:
        return doc > first_doc
    return (doc > first_doc) | ((doc == first_doc) & (x["start"] > x["start"][lead]))


def pack_columns(x: dict[str, np.ndarray], fields=FIELDS) -> bytes:
    """Columns one after the other; documents as differences, which compress to little."""
    out = [np.int64(len(x[fields[0][0]])).tobytes()]
    for f, t in fields:
        v = np.ascontiguousarray(x[f], t)
        out.append(np.diff(v, prepend=v.dtype.type(0)).tobytes() if f == "doc" else v.tobytes())
    return b"".join(out)


def unpack_columns(blob: bytes, fields=FIELDS) -> dict[str, np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, {}
    for f, t in fields:
        out[f] = np.frombuffer(blob, t, n, at)
        at += n * np.dtype(t).itemsize
        if f == "doc":
            out[f] = np.cumsum(out[f])
    return out


def concat(parts: list[dict[str, np.ndarray]], fields=FIELDS) -> dict[str, np.ndarray]:
    return {f: np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, t) for f, t in fields}


#: bucket of the exchange, and what goes there: `whole` columns are already known to be repeated.
SENT = "bucket int, whole boolean, data binary"


def hot_anchors(docs: DataFrame, spec: Windows) -> np.ndarray:
    """Anchors that very many documents hold (at most a few hundred), from a sample of documents.

    Like the sample of a range partitioning this only decides where rows go: segments of a hot anchor are
    dealt by content instead of by anchor, and all count as open. Which anchors are found doesn't change results.
    """
    arrow_batches(docs.sparkSession)
    part = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(HINT_OF)) == 0)).select("doc_id", "text")

    def run(batches):
        for batch in batches:
            h, n = [], 0
            for i, j, data, offs in text_blocks(batch.column(1)):
                x = segments(spec, data, offs)
                h.append(np.unique(np.stack([x["h"], x["row"].astype(np.uint64)]), axis=1)[0])
                n += j - i
            u, c = np.unique(np.concatenate(h), return_counts=True) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            some = c > 1  # once in a batch is not hot
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[u[some].view(np.int64), 0]), pa.array(np.r_[c[some], 0]), pa.array(np.r_[np.zeros(some.sum(), np.int64), n])], ["h", "n", "docs"])

    counts = part.mapInArrow(run, "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    total = counts.agg(F.sum("docs")).first()[0] or 0
    least = max(HOT_LEAST, total // HOT_SHARE)
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def buckets_of(x: dict[str, np.ndarray], hot: np.ndarray, P: int) -> np.ndarray:
    """The bucket of each segment: by anchor, or by content if the anchor is hot."""
    key = x["h"].copy()
    if len(hot):
        spread = np.isin(key, hot)
        key[spread] = mix(key[spread] ^ x["s"][spread])
    return (key % np.uint64(P)).astype(np.int64)


def sent_segments(docs: DataFrame, spec: Windows, hot: np.ndarray) -> DataFrame:
    """Segments of docs, packed, for the buckets of an exchange by anchor."""
    spark = docs.sparkSession
    arrow_batches(spark)
    P = partitions(spark)

    def run(batches):
        held, n = [], 0

        def flush():
            x = order_of(concat(held))
            first = new_content(x)
            run_of = np.cumsum(first) - 1
            lead = np.flatnonzero(first)
            repeated = later(spec, x, lead[run_of])
            buckets, wholes, blobs = [], [], []
            for whole, pick in ((False, np.flatnonzero(~repeated)), (True, np.flatnonzero(repeated))):
                y = {k: v[pick] for k, v in x.items()}
                bucket = (y["doc"].astype(np.uint64) % np.uint64(P)).astype(np.int64) if whole else buckets_of(y, hot, P)
                o = np.lexsort((y["start"], y["doc"], bucket))
                cut = np.searchsorted(bucket[o], np.arange(P + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    buckets.append(b)
                    wholes.append(whole)
                    blobs.append(pack_columns({k: v[o[cut[b] : cut[b + 1]]] for k, v in y.items()}))
            for i in range(0, len(buckets), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets[i : i + 64], pa.int32()), pa.array(wholes[i : i + 64]), pa.array(blobs[i : i + 64], pa.binary())],
                    ["bucket", "whole", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offs in text_blocks(batch.column(1)):
                x = segments(spec, data, offs)
                x["doc"] = ids[i:j][x.pop("row")].astype(np.int64)
                held.append(x)
                n += len(x["h"])
            if n >= SEND:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, SENT)


#: kind 0: a segment that is repeated whole; kind 1: an open one, with the contents of its anchor; kind 2: a run of the index.
TOLD = "kind int, h long, doc_id long, start int, n int, contents int, bucket int, data binary"
_TOLD = [("kind", pa.int32()), ("h", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("contents", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())]


def told(kind: int, x: dict[str, np.ndarray], contents=None):
    """Rows of kind 0 or 1, a few tens of thousands at a time."""
    for i in range(0, len(x["doc"]), 20_000):
        s = slice(i, i + 20_000)
        n = len(x["doc"][s])
        cols = [np.full(n, kind, np.int32), np.ascontiguousarray(x["h"][s]).view(np.int64), x["doc"][s], x["start"][s], x["n"][s].astype(np.int32), contents[s].astype(np.int32) if contents is not None else np.zeros(n, np.int32), np.zeros(n, np.int32)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.nulls(n, pa.binary())], [f for f, _ in _TOLD])


def resolve(spec: Windows, fresh: dict[str, np.ndarray], hot: np.ndarray, cells=()):
    """(repeated, open, contents of the anchor of each open one, new contents) of the fresh segments of one bucket.

    cells: sorted parts of the runs of earlier batches, each the first segments of contents. They are joined with
    the sorted fresh contents one after the other (found() looks up a cell's keys in order); what they know is
    compared with but not judged: every content in them is of an earlier document.
    """
    x = order_of(fresh)
    first = new_content(x)
    lead, run_of = np.flatnonzero(first), np.cumsum(first) - 1
    h, s = x["h"][lead], x["s"][lead]
    known, others = np.zeros(len(lead), bool), np.zeros(len(lead), np.int64)  # by content: in a run; by anchor: contents in runs
    witnesses = []
    for cell in cells:
        at, lo, hi = found(h, s, cell["h"], cell["s"])
        met = hi > lo
        others_at = lo[met]  # the first content of the anchor stands for the anchor
        np.add.at(others, others_at, 1)
        inside = met & (at < hi)
        same = inside.copy()
        same[inside] = s[at[inside]] == cell["s"][inside]
        known[at[same]] = True
        witnesses.append(({k: v[met] for k, v in cell.items()}, others_at))
    repeated = later(spec, x, lead[run_of]) | known[run_of] if len(lead) else np.zeros(0, bool)
    # anchors with several contents, at least one of them new
    head = np.r_[True, h[1:] != h[:-1]][: len(h)]
    anchor = np.cumsum(head) - 1
    contents = np.bincount(anchor[~known], minlength=int(head.sum())) + others[head] if len(h) else others
    any_new = np.bincount(anchor, weights=~known) > 0 if len(h) else known
    spread = np.isin(h[head], hot)  # contents of a hot anchor may be in other buckets too
    wide = ((contents > 1) & any_new) | spread
    contents = np.where(spread, 1 << 30, contents)
    # open: every segment of the content's first document (several places only if the document repeats it), and what runs know of the anchor
    mine = np.zeros(len(run_of), bool)
    if len(lead):
        mine = wide[anchor][run_of] & ~repeated & (first if spec.within else x["doc"] == x["doc"][lead][run_of])
    opened = [{k: v[mine] for k, v in x.items()}]
    numbers = [contents[anchor[run_of[mine]]]]
    for cell, at in witnesses:
        some = wide[anchor[at]]
        opened.append({k: v[some] for k, v in cell.items()})
        numbers.append(contents[anchor[at[some]]])
    fresh_leads = lead[~known]
    take = lambda m: {k: v[m] for k, v in x.items()}
    return take(repeated), concat(opened), np.concatenate(numbers), take(fresh_leads)


def found(h: np.ndarray, s: np.ndarray, kh: np.ndarray, ks: np.ndarray):
    """Place of each key (kh, ks) in the sorted keys (h, s), and the range of keys that share kh."""
    lo, hi = np.searchsorted(h, kh, "left"), np.searchsorted(h, kh, "right")
    at, end = lo.copy(), hi.copy()
    while (live := np.flatnonzero(at < end)).size:
        mid = (at[live] + end[live]) // 2
        below = s[mid] < ks[live]
        at[live] = np.where(below, mid + 1, at[live])
        end[live] = np.where(below, end[live], mid)
    return at, lo, hi


def merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Two sorted lists of contents as one."""
    at, _, _ = found(a["h"], a["s"], b["h"], b["s"])
    return {k: np.insert(a[k], at, b[k]) for k in a}


def spans_of(rows: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<start, n>> of rows that say that n windows from start are repeated."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # bounded by the document


def covered_symbols(starts: np.ndarray, counts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Mask of the symbols of a document that repeated windows cover."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts + size - 1, length), -1)
    return np.cumsum(edge[:-1]) > 0
