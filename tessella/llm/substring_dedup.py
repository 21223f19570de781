"""Incremental substring dedup with a log-structured fingerprint index.

Documents come in batches. The index of what came before is a list of immutable runs: for each
bucket, the winnowed window fingerprints (anchor hash, content hash) of one or more batches, sorted,
each with the first document and place that has it, in cells of CELL fingerprints. Runs are files of a
bucketed table: only a batch's own fingerprints are shuffled, to the buckets; the runs are read where
they are. A bucket is handled in one task: the batch's fingerprints are sorted and merge-joined with
the sorted cells one after the other; a content that an earlier document has is a hit, its windows are
repeated whole. Where an anchor is known with other contents, the windows themselves are verified: both
documents are read again and their SIZE-word windows compared. The new contents of the batch are
appended as a new run, and when there are more than FAN_IN runs they are merged into one, bucket by
bucket and without a shuffle.

A word is removed if it is in a window whose words also start in a document with a smaller doc_id,
so batches must come in ascending ranges of doc_id; inside a batch any order will do.

Cases: null text has no words; documents with fewer than SIZE words lose none; rows that share an id
are one document; rows with a null id are neither removed from nor compared; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import winnow
from .core import arrow_batches, materialize, own_shuffles, partitions, release, remove_path, shared_dir, text_blocks, windows, words

SIZE, SHINGLE, FAN_IN, BATCHES = 13, 5, 2, 4
#: Fingerprints of a cell of a run.
CELL = 1 << 16
SPEC = winnow.Windows(SIZE, SHINGLE, words=True, within=False)
RUN = "bucket int, data binary"


def _cells(bucket: int, x: dict[str, np.ndarray]):
    """Rows (bucket, data) of sorted contents."""
    for i in range(0, len(x["h"]), CELL):
        yield bucket, winnow.pack_columns({k: v[i : i + CELL] for k, v in x.items()})


def _unpacked(column) -> list[dict[str, np.ndarray]]:
    return [winnow.unpack_columns(b) for b in column.to_pylist()]


class FingerprintIndex:
    """The runs, and the documents behind them (for verification). close() deletes the runs."""

    def __init__(self, store: DataFrame, fan_in: int = FAN_IN):
        self.store, self.fan_in, self.spark = store, fan_in, store.sparkSession
        self.runs, self.name = 0, None  # runs in the table of that name
        self.open: list[DataFrame] = []
        self.written: list[DataFrame] = []
        self.buckets = partitions(self.spark)
        self.hot = winnow.hot_anchors(store, SPEC)  # the same for all runs

    def _table(self) -> str:
        return f"tessella_runs_{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame, name: str) -> None:
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}"
        with own_shuffles(self.spark):
            rows.write.bucketBy(self.buckets, "bucket").option("path", path).option("compression", "zstd").mode("append").saveAsTable(name)

    def _drop(self, name: str | None) -> None:
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, f"{shared_dir(self.spark).rstrip('/')}/{name}")

    def ingest(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Windows (doc_id, start, n) of a batch that the fingerprints show to be repeated; the batch then
        belongs to the index. What they leave open waits for verify(). After the last batch of an index that
        is not kept no run is written."""
        hot = self.hot

        def judge(sent: pa.Table, runs) -> pa.Table:
            bucket, fresh, out = sent.column("bucket")[0].as_py() if sent.num_rows else 0, [], []
            whole = np.asarray(sent.column("whole"), bool)
            for known, x in zip(whole, _unpacked(sent.column("data"))):
                if known:
                    out += winnow.told(0, x)
                else:
                    fresh.append(x)
            if fresh:
                cells = (winnow.unpack_columns(c.as_py()) for c in runs.column("data")) if runs is not None else ()
                repeated, opened, contents, new = winnow.resolve(SPEC, winnow.concat(fresh), hot, cells)
                out += [*winnow.told(0, repeated), *winnow.told(1, opened, contents)]
                for _, blob in _cells(bucket, new) if not last else ():
                    row = zip([2, None, None, None, None, None, bucket, blob], winnow._TOLD)
                    out.append(pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in row], [f for f, _ in winnow._TOLD]))
            return pa.Table.from_batches(out, pa.schema(winnow._TOLD))

        sent = winnow.sent_segments(batch, SPEC, hot).repartition(self.buckets, "bucket").groupBy("bucket")
        if self.name:
            both = sent.cogroup(self.spark.table(self.name).groupBy("bucket"))
            found = both.applyInArrow(lambda left, right: judge(left, right), winnow.TOLD)
        else:
            found = sent.applyInArrow(lambda table: judge(table, None), winnow.TOLD)
        told = materialize(found, "lsm")
        self.written.append(told)
        if not last:
            self.name = self.name or self._table()
            self._write(told.where("kind = 2").select("bucket", "data"), self.name)
            self.runs += 1
        if self.runs > self.fan_in:
            self.compact()
        self.open.append(told.where("kind = 1").select("h", "doc_id", "start", "n"))
        return told.where("kind = 0").select("doc_id", "start", "n")

    def compact(self) -> None:
        """Merge all runs into one, which takes their place."""

        def merge(cells: pa.Table) -> pa.Table:
            parts = sorted(_unpacked(cells.column("data")), key=lambda x: len(x["h"]))
            while len(parts) > 1:  # the two shortest first
                parts = sorted([winnow.merged(parts[0], parts[1]), *parts[2:]], key=lambda x: len(x["h"]))
            rows = list(_cells(cells.column("bucket")[0].as_py(), parts[0]))
            return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

        old, self.name = self.name, self._table()
        self._write(self.spark.table(old).groupBy("bucket").applyInArrow(merge, RUN), self.name)
        self._drop(old)
        self.runs = 1

    def close(self) -> None:
        """Delete the runs and what batches have left; the results of ingest() and verify() must be read by then."""
        self._drop(self.name)
        self.name, self.runs = None, 0
        for table in self.written:
            release(table)
        self.written = []

    def verify(self) -> DataFrame:
        """Of the segments that batches left open, the windows (doc_id, start, n) whose words an earlier
        document has; the texts are read once for all batches since the last call."""
        P = self.buckets
        opened = self.open[0]
        for more in self.open[1:]:
            opened = opened.union(more)
        opened, self.open = opened.distinct(), []
        lists = opened.groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n")).alias("segs"))
        lists = materialize(lists, "lsm")
        self.written.append(lists)
        texts = self.store.select("doc_id", "text").join(lists, "doc_id")
        fields = [("w", np.uint64), ("h", np.uint64), ("doc", np.int64), ("start", np.int32)]
        places = fields[2:]

        def read(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                for i, j, data, offs in text_blocks(batch.column("text")):
                    sym, _, first = SPEC.symbols(data, offs)
                    g = windows(sym, SIZE, 5)
                    segs = batch.column("segs").slice(i, j - i)
                    row = np.repeat(np.arange(j - i), np.diff(np.asarray(segs.offsets)))
                    flat = segs.flatten()
                    h, start, n = (np.asarray(flat.field(k)) for k in range(3))
                    fits = start.astype(np.int64) + n + SIZE - 1 <= np.diff(first)[row]  # of equal ids, the text it came from
                    h, start, n, row = h[fits].view(np.uint64), start[fits].astype(np.int64), n[fits].astype(np.int64), row[fits]
                    q = np.repeat(np.arange(len(h)), n)
                    st = start[q] + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                    x = {"w": g[first[row[q]] + st], "h": h[q], "doc": ids[i:j][row[q]], "start": st}
                    # of a window that several documents of the block have, the first goes on as a witness; the others are repeated
                    o = np.lexsort((x["start"], x["doc"], x["h"], x["w"]))
                    x = {k: v[o] for k, v in x.items()}
                    sure = after_first(x)
                    for whole, y, names in ((False, {k: v[~sure] for k, v in x.items()}, fields), (True, {k: v[sure] for k, v in x.items()}, places)):
                        bucket = ((y["doc"].astype(np.uint64) if whole else y["w"]) % np.uint64(P)).astype(np.int64)
                        o = np.lexsort((y["start"], y["doc"], bucket))
                        edge = np.searchsorted(bucket[o], np.arange(P + 1))
                        some = np.flatnonzero(np.diff(edge)).tolist()
                        blobs = [winnow.pack_columns({f: y[f][o[edge[k] : edge[k + 1]]] for f, _ in names}, names) for k in some]
                        if some:
                            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([whole] * len(some)), pa.array(blobs, pa.binary())], ["bucket", "whole", "data"])

        def after_first(x):
            first = np.r_[True, (x["w"][1:] != x["w"][:-1]) | (x["h"][1:] != x["h"][:-1])][: len(x["w"])]
            return x["doc"] > x["doc"][np.flatnonzero(first)][np.cumsum(first) - 1] if len(first) else first

        def judge(batches):
            held, sure = [], []
            for batch in batches:
                for whole, blob in zip(batch.column("whole").to_pylist(), batch.column("data").to_pylist()):
                    (sure if whole else held).append(winnow.unpack_columns(blob, places if whole else fields))
            x = winnow.concat(held, fields)
            o = np.lexsort((x["start"], x["doc"], x["h"], x["w"]))
            x = {k: v[o] for k, v in x.items()}
            hit = after_first(x)
            sure = winnow.concat(sure, places)
            doc, st = np.r_[x["doc"][hit], sure["doc"]], np.r_[x["start"][hit], sure["start"]]
            q = np.lexsort((st, doc))
            doc, st = doc[q], st[q]
            if len(doc):
                run = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (st[1:] != st[:-1] + 1)])
                yield pa.RecordBatch.from_arrays([pa.array(doc[run]), pa.array(st[run]), pa.array(np.diff(np.r_[run, len(doc)]).astype(np.int32))], ["doc_id", "start", "n"])

        sent = texts.select("doc_id", "text", "segs").mapInArrow(read, winnow.SENT)
        return sent.repartitionById(P, F.col("bucket")).mapInArrow(judge, "doc_id long, start int, n int")


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, spans of repeated windows, with docs taken in `batches` ascending ranges of doc_id."""
    arrow_batches(docs.sparkSession)
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    index = FingerprintIndex(docs)
    edges = [None, *sorted({int(c) for c in cuts}), None]
    found = None
    for lo, hi in zip(edges, edges[1:]):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") >= lo)
        if hi is not None:
            part = part.where(F.col("doc_id") < hi)
        rows = index.ingest(part, last=hi is None)
        found = rows if found is None else found.union(rows)
    found = found.unionByName(index.verify())
    spans = materialize(winnow.spans_of(found), "lsm")
    index.close()
    return spans


def removal_report(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    slim = docs.select("doc_id", "text")
    spans = repeated_spans(slim, batches)
    arrow_batches(docs.sparkSession)
    joined = slim.join(spans.withColumnRenamed("doc_id", "_id"), slim.doc_id == F.col("_id"), "left")

    def run(frames):
        for batch in frames:
            if not batch.num_rows:
                continue
            spans_at = batch.column("spans")
            for i, j, data, offs in text_blocks(batch.column("text")):
                s, e, row, _ = words(data, offs)
                at = np.searchsorted(row, np.arange(j - i + 1))
                out = []
                for k in range(i, j):
                    a, b = at[k - i], at[k - i + 1]
                    gone = np.zeros(b - a, bool)
                    if spans_at[k].is_valid:
                        v = spans_at[k].values
                        gone = winnow.covered_symbols(np.asarray(v.field(0)).astype(np.int64), np.asarray(v.field(1)).astype(np.int64), SIZE, b - a)
                    ks, ke = s[a:b][~gone], e[a:b][~gone]
                    size = ke - ks + 1  # and one space
                    put = np.repeat(ks - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    body = data[np.minimum(put, len(data) - 1)] if len(put) else np.zeros(0, np.uint8)
                    if len(body):
                        body[np.cumsum(size) - 1] = 32
                        body = body[:-1]
                    out.append((int(b - a), int(gone.sum()), hashlib.sha256(body.tobytes()).hexdigest()))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
