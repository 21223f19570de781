"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts earlier.

Repeated strings are found in Burrows-Wheeler transforms and longest-common-prefix arrays of
collections of segments. A collection is built column by column: in round j the suffix of length j
of every document that is long enough is inserted, that is one symbol for each document. The rank
of its symbol in the transform so far gives its place (LF mapping), and the prefix it shares with
its neighbours is one more than the least common prefix between the places it was extended from.
Transform and common prefixes go from round to round through sequential files (`Tape`: spooled,
in memory until SPOOL bytes, and gone when the task ends). Runs of rows with a common prefix of at
least LENGTH bytes are the places of one string; all but the first place are repeated.

What makes this fit a cluster is that collections are small: winnow.py leaves only segments whose
windows could be repeated in another segment of the same anchor, and anchors are independent. An
anchor with more than HOT contents is split into single windows, dealt by the window's hash. Equal windows
of such an anchor are compared byte by byte where they are read, and a task sends on the first of them; those
that meet go through collections of bounded size one after the other, with the first place of each string.

Cases: null text is empty; matches never cross documents; rows that
share an id are places of one document, and a row that is there twice is not repeated by itself; rows with a null
id are neither removed from nor compared; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import winnow
from .core import arrow_batches, fresh_name, materialize, partitions, release, run_key, span_hash, text_blocks

LENGTH, SHINGLE = 100, 40
SPEC = winnow.Windows(LENGTH, SHINGLE, words=False, within=True)
#: Contents of an anchor above which it is split; bytes of a collection; bytes of a tape kept in memory.
HOT, COLLECTION, SPOOL = 4096, 1 << 16, 16 << 20


class Tape:
    """A sequential file that is rewritten each round."""

    def __init__(self, first: np.ndarray):
        self.dtype = first.dtype
        self.write(first)

    def write(self, values: np.ndarray) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)  # noqa: SIM115
        self.file.write(values.tobytes())

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.dtype)


def collection_bwt(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform (byte + 1, 0 where a document begins) and common prefix with the row before, of all
    suffixes of the documents data[offs[i]:offs[i+1]]; the first rows are the empty suffixes in order."""
    m, size = len(offs) - 1, np.diff(offs)
    text = data.astype(np.uint8) + np.uint8(1)  # 0xFF is in no UTF-8 text
    end = offs[1:]
    before = lambda doc, j: np.where(size[doc] > j, text[np.maximum(end[doc] - j - 1, 0)], np.uint8(0)).astype(np.uint8)
    small = np.uint8 if size.max(initial=0) < 255 else np.uint32  # holds any common prefix
    bwt, lcp = Tape(before(np.arange(m), 0)), Tape(np.zeros(m, small))
    place = np.arange(m)  # row of the last suffix inserted of each document
    for j in range(1, int(size.max(initial=0)) + 1):
        doc = np.flatnonzero(size >= j)
        b, c = bwt.read(), lcp.read()
        by_symbol = np.argsort(b, kind="stable")
        extended = by_symbol[np.count_nonzero(b == 0) :]  # row m + t begins with b[extended[t]], then goes on as row extended[t]
        current = np.zeros(len(b), bool)
        current[place[doc]] = True
        t = np.flatnonzero(current[extended])  # the rows that are new
        symbol = b[extended]
        # common prefixes of the new rows and of those after them
        near = np.zeros(len(extended) + 1, bool)
        near[t] = near[t + 1] = True
        ask = np.flatnonzero(near[:-1])
        one = ask[(ask > 0) & (symbol[ask] == symbol[ask - 1])]
        value = np.zeros(len(extended), small)
        if len(one):
            lo, hi = extended[one - 1] + 1, extended[one] + 1
            o = np.argsort(lo, kind="stable")
            c_pad = np.append(c, small(0))
            value[one[o]] = np.minimum.reduceat(c_pad, np.c_[lo[o], hi[o]].ravel())[::2] + small(1)
        fresh = np.zeros(m + len(extended), bool)
        fresh[m + t] = True
        new_b, new_c = np.empty(len(fresh), np.uint8), np.empty(len(fresh), small)
        new_b[~fresh], new_c[~fresh] = b, c
        new_c[m + ask] = value[ask]
        sorted_doc = doc[np.argsort(place[doc], kind="stable")]
        sorted_doc = sorted_doc[np.argsort(b[place[sorted_doc]], kind="stable")]
        place[sorted_doc] = m + t
        new_b[m + t] = before(sorted_doc, j)
        bwt.write(new_b)
        lcp.write(new_c)
    return bwt.read(), lcp.read()


def repeated_windows(data: np.ndarray, offs: np.ndarray, key: np.ndarray, start: np.ndarray, length: int = LENGTH):
    """(document of the collection, offset in it) of every window of `length` bytes that is not the first
    of its string; places are ordered by key, then start + offset."""
    bwt, lcp = collection_bwt(data, offs)
    m, size = len(offs) - 1, np.diff(offs)
    by_symbol = np.argsort(bwt, kind="stable")
    ends = np.count_nonzero(bwt == 0)
    step = np.zeros(len(bwt), np.int64)
    step[by_symbol[ends:]] = m + np.arange(len(bwt) - ends)
    string = np.cumsum(lcp < length)  # equal for rows that share `length` bytes or more
    row, docs, at = np.arange(m), [], []
    rows = []
    for j in range(1, int(size.max(initial=0)) + 1):
        live = np.flatnonzero(size >= j)
        row[live] = step[row[live]]
        if j >= length:
            docs.append(live)
            at.append(size[live] - j)
            rows.append(string[row[live]])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, a, s = np.concatenate(docs), np.concatenate(at), np.concatenate(rows)
    place = start[d] + a
    o = np.lexsort((place, key[d], s))
    d, a, s, place = d[o], a[o], s[o], place[o]
    lead = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])[np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1]
    later = (key[d] != key[d][lead]) | (place != place[lead])  # of repeated rows, the same place is not repeated
    return d[later], a[later]


def equal_to_earlier(data: np.ndarray, at: np.ndarray, h: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the window of `length` bytes at each place is, byte by byte, that of the first place of its hash."""
    o = np.lexsort((start, doc, h))
    first = np.r_[True, h[o][1:] != h[o][:-1]]
    lead = o[np.flatnonzero(first)][np.cumsum(first) - 1]
    out = np.zeros(len(at), bool)
    ask = np.flatnonzero((doc[o] != doc[lead]) | (start[o] != start[lead]))
    for i in range(0, len(ask), 8192):
        a, b = o[ask[i : i + 8192]], lead[ask[i : i + 8192]]
        span = np.arange(length)
        out[a] = (data[at[a][:, None] + span] == data[at[b][:, None] + span]).all(1)
    return out


_SHIPPED = [("h", np.uint64), ("doc", np.int64), ("start", np.int32), ("n", np.uint8)]


def _open_windows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """Repeated windows (doc_id, start, n) among the open segments."""
    spark = docs.sparkSession
    P = partitions(spark)
    lists = opened.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n", "contents")).alias("segs"))
    lists = materialize(lists, "sa")
    texts = docs.select("doc_id", "text").join(lists, "doc_id")

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, data, offs in text_blocks(batch.column("text")):
                segs = batch.column("segs").slice(i, j - i)
                count = np.diff(np.asarray(segs.offsets))
                flat = segs.flatten()
                h, start, n, contents = (np.asarray(flat.field(k)) for k in range(4))
                row = np.repeat(np.arange(j - i), count)
                fits = start.astype(np.int64) + n + LENGTH - 1 <= np.diff(offs)[row]  # of equal ids, the text it came from
                h, start, n, contents, row = h[fits].view(np.uint64), start[fits].astype(np.int64), n[fits].astype(np.int64), contents[fits], row[fits]
                hot = contents > HOT
                if hot.any():  # one document for each window, dealt by its hash
                    w = np.repeat(np.flatnonzero(hot), n[hot])
                    off = np.arange(len(w)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                    ws, wr = start[w] + off, row[w]
                    wh = span_hash(data, offs[wr] + ws, offs[wr] + ws + LENGTH, run_key())
                    sure = equal_to_earlier(data, offs[wr] + ws, wh, ids[i:j][wr].astype(np.int64), ws)
                    if sure.any():
                        yield from known(ids[i:j][wr[sure]].astype(np.int64), ws[sure])
                    cold = ~hot
                    h, start, row = np.r_[h[cold], wh[~sure]], np.r_[start[cold], ws[~sure]], np.r_[row[cold], wr[~sure]]
                    n = np.r_[n[cold], np.ones(int((~sure).sum()), np.int64)]
                if not len(h):
                    continue
                bucket = (h % np.uint64(P)).astype(np.int64)
                o = np.lexsort((h, bucket))
                h, start, n, row, bucket = h[o], start[o], n[o], row[o], bucket[o]
                size = n + LENGTH - 1
                begin = offs[row] + start
                flat_at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                body, ends = data[flat_at], np.r_[0, np.cumsum(size)]
                edge = np.searchsorted(bucket, np.arange(P + 1))
                some = np.flatnonzero(np.diff(edge)).tolist()
                heads = [winnow.pack_columns({"h": h[a:b], "doc": ids[i:j][row[a:b]], "start": start[a:b], "n": n[a:b]}, _SHIPPED) for a, b in ((edge[k], edge[k + 1]) for k in some)]
                bodies = [body[ends[edge[k]] : ends[edge[k + 1]]].tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["bucket", "head", "body"])

    def known(doc, st):
        """Windows that are already known to be repeated, with no bytes, dealt by document."""
        bucket = (doc.astype(np.uint64) % np.uint64(P)).astype(np.int64)
        o = np.lexsort((st, doc, bucket))
        edge = np.searchsorted(bucket[o], np.arange(P + 1))
        some = np.flatnonzero(np.diff(edge)).tolist()
        heads = [winnow.pack_columns({"doc": doc[o[edge[k] : edge[k + 1]]], "start": st[o[edge[k] : edge[k + 1]]]}, _SHIPPED[1:3]) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(heads, pa.binary()), pa.nulls(len(some), pa.binary())], ["bucket", "head", "body"])

    def judge(batches):
        heads, bodies = [], []
        for batch in batches:
            for head, body in zip(batch.column("head").to_pylist(), batch.column("body").to_pylist()):
                if body is None:
                    x = winnow.unpack_columns(head, _SHIPPED[1:3])
                    yield runs_of(x["doc"], x["start"].astype(np.int64))
                else:
                    heads.append(winnow.unpack_columns(head, _SHIPPED))
                    bodies.append(body)
        if not heads:
            return
        x = winnow.concat(heads, _SHIPPED)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        size = x["n"].astype(np.int64) + LENGTH - 1
        begin = np.cumsum(size) - size
        o = np.argsort(x["h"], kind="stable")
        h = x["h"][o]
        group = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
        total = np.r_[0, np.cumsum(size[o])]
        a = 0
        while a < len(group) - 1:  # whole anchors, about COLLECTION bytes together
            b = max(a + 1, int(np.searchsorted(total[group], total[group[a]] + COLLECTION, "right")) - 1)
            pick = o[group[a] : group[b]]
            a = b
            if size[pick].sum() <= COLLECTION or (x["n"][pick] > 1).any():  # at most HOT contents, or several anchors
                later = repeated(x, data, begin, size, pick)
                if len(later[0]):
                    yield runs_of(*later)
                continue
            pick = pick[np.lexsort((x["start"][pick], x["doc"][pick]))]
            step, lead = COLLECTION // LENGTH, pick[:0]  # lead: the first place of each string so far
            for k in range(0, len(pick), step):
                part = np.r_[lead, pick[k : k + step]]
                doc, st = later = repeated(x, data, begin, size, part)
                if len(doc):
                    yield runs_of(*later)
                place = lambda d, s: d.astype(np.uint64) * np.uint64(1 << 32) + s.astype(np.uint64)
                lead = part[~np.isin(place(x["doc"][part], x["start"][part]), place(doc, st))]

    def repeated(x, data, begin, size, pick):
        """(document, start) of the repeated windows of a collection."""
        s = size[pick]
        at = np.repeat(begin[pick] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        d, off = repeated_windows(data[at], np.r_[0, np.cumsum(s)], x["doc"][pick], x["start"][pick].astype(np.int64))
        return x["doc"][pick][d], x["start"][pick][d].astype(np.int64) + off

    def runs_of(doc, st):
        q = np.lexsort((st, doc))
        doc, st = doc[q], st[q]
        run = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (st[1:] != st[:-1] + 1)])
        return pa.RecordBatch.from_arrays([pa.array(doc[run]), pa.array(st[run].astype(np.int32)), pa.array(np.diff(np.r_[run, len(doc)]).astype(np.int32))], ["doc_id", "start", "n"])

    sent = texts.select("doc_id", "text", "segs").mapInArrow(cut, "bucket int, head binary, body binary")
    return sent.repartitionById(P, F.col("bucket")).mapInArrow(judge, "doc_id long, start int, n int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: runs of windows (start, n) that are repeated, for each document that has any."""
    arrow_batches(docs.sparkSession)
    spark = docs.sparkSession
    P = partitions(spark)

    def judge(batches):
        fresh = []
        for batch in batches:
            for whole, blob in zip(batch.column("whole").to_pylist(), batch.column("data").to_pylist()):
                x = winnow.unpack_columns(blob)
                if whole:
                    yield from winnow.told(0, x)
                else:
                    fresh.append(x)
        if fresh:
            repeated, opened, contents, _ = winnow.resolve(SPEC, winnow.concat(fresh), hot)
            yield from winnow.told(0, repeated)
            yield from winnow.told(1, opened, contents)

    hot = winnow.hot_anchors(docs, SPEC)
    sent = winnow.sent_segments(docs, SPEC, hot)
    told = materialize(sent.repartitionById(P, F.col("bucket")).mapInArrow(judge, winnow.TOLD), "sa")
    judged = _open_windows(docs, told.where("kind = 1").select("h", "doc_id", "start", "n", "contents"))
    rows = told.where("kind = 0").select("doc_id", "start", "n").unionByName(judged)
    spans = materialize(winnow.spans_of(rows), "sa")
    release(told)
    return spans


def _with_kept(docs: DataFrame, spans: DataFrame, schema: str, row) -> DataFrame:
    """row(batch, i, whole bytes, mask of removed bytes) for each row of docs."""
    arrow_batches(docs.sparkSession)
    ident, held = fresh_name(docs, "_id"), fresh_name(docs, "_spans")
    joined = docs.join(spans.select(F.col("doc_id").alias(ident), F.col("spans").alias(held)), F.col("doc_id") == F.col(ident), "left")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            spans_at = batch.column(held)
            for i, j, data, offs in text_blocks(batch.column("text")):
                out = []
                for k in range(i, j):
                    body = data[offs[k - i] : offs[k - i + 1]]
                    gone = np.zeros(len(body), bool)
                    if spans_at[k].is_valid:
                        v = spans_at[k].values
                        gone = winnow.covered_symbols(np.asarray(v.field(0)).astype(np.int64), np.asarray(v.field(1)).astype(np.int64), LENGTH, len(body))
                    out.append((body, gone))
                yield row(batch.slice(i, j - i), out)

    return joined.mapInArrow(run, schema)


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""

    def row(batch, parts):
        n = [len(b) for b, _ in parts]
        removed = [int(g.sum()) for _, g in parts]
        runs = [int((np.diff(g.astype(np.int8), prepend=0) == 1).sum()) for _, g in parts]
        sha = [hashlib.sha256(b[~g].tobytes()).hexdigest() for b, g in parts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    slim = docs.select("doc_id", "text")
    return _with_kept(slim, repeated_spans(slim), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", row)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text (a character that is cut in two goes whole); null text stays null."""
    schema = docs.schema
    names = docs.columns

    def row(batch, parts):
        text = pa.array([b[~g].tobytes().decode("utf-8", "ignore") for b, g in parts], pa.string())
        null = batch.column("text").is_null()
        text = pc.if_else(null, pa.scalar(None, pa.string()), text)
        return pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], names)

    spans = repeated_spans(docs.select("doc_id", "text"))
    return _with_kept(docs, spans, schema, row)
