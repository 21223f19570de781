"""Alignment of two tokenizers over the same texts by an event sweep.

Every token of either side is an event at the byte offset where it ends. Events travel as runs (document,
offset, side, ids of a bounded number of tokens), the union of both sides is shuffled by document and sorted by
offset inside partitions, and a state machine reads it as a stream. Its state is what follows the last
offset at which both sides end, so a document of any length passes through in pieces: at such an offset a
group of tokens is closed, and each event links the tokens of both sides that are open just before it.

A pair of ids is counted once for each document that holds it linked. Pairs are pre-aggregated by document
and by block of documents and go to buckets by the first id (`lexicon`); counts are summed in two levels, so
that ids that are everywhere are spread, and sent back to the blocks that asked.

Cases: a text that is null or empty, or that either side does not give back byte for byte (the second side writes
U+2581 as a blank), has no tokens and zeros; strings of special tokens are plain text; equal rows are
documents of their own; rows with a null id are kept; an empty table gives no rows; further columns
are ignored. Rows are told apart by their place in the scan, so docs should be a table that is read or written,
not the output of a shuffle whose order may change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .core import arrow_batches, materialize, mix
from .lexicon import BUCKET, blank_cuts, block_number, blocks_of, bucket_count, by_bucket, flat_bytes, pack_many, pattern_cuts, ragged, sent_array, spans, to_blocks, unpack_many

A, B = 0, 1
#: Bytes of text whose distinct words are encoded together, about.
EVENT_BLOCK = 6 << 20


class Sizes(NamedTuple):
    """Sizes that bound what a task holds; results don't depend on them."""

    #: Tokens of a run; tokens that are merged together; pairs of a block, about.
    run: int = 1 << 16
    tokens: int = 1 << 18
    pairs: int = 2 << 20
    #: Bytes of text behind a bucket of pairs; buckets at most: beyond it a bucket is split by block, whose parts are summed in a second level.
    bucket: int = BUCKET
    buckets: int = 4096


# ---------------------------------------------------------------- the two sides


@cache
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out, splits = [], True
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        splits &= "▁" not in piece.lstrip("▁")
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return model, pa.array(out, pa.large_binary()), splits


def side_a(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of the texts in them) by the rank file: each distinct word of the block is encoded once."""
    return _by_parts(data, offsets, pattern_cuts(data, offsets), lambda words: byte_bpe.encode_words(path, words))


def side_b(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by the piece model, which puts a blank before a text; ours begin with it. No piece has a blank after
    another character, so parts that begin with blanks are encoded alone, each distinct one once."""
    model, _, splits = _pieces(path)

    blank = model.encode("a ")[len(model.encode("a")) :]

    def encode(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = model.encode([p[1:].decode() for p in parts], num_threads=1)
        ids = [x if len(p) > 1 else blank for p, x in zip(parts, ids)]  # of an empty text nothing is made
        return np.fromiter((i for x in ids for i in x), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    return _by_parts(data, offsets, blank_cuts(data, offsets) if splits else offsets, encode)


def _by_parts(data, offsets, cuts, encode):
    parts = spans(data, cuts).dictionary_encode()
    ids, counts = encode(parts.dictionary.to_pylist())
    codes = np.asarray(parts.indices).astype(np.int64)
    start = np.cumsum(counts) - counts
    edge = np.r_[0, np.cumsum(counts[codes])][np.searchsorted(cuts, offsets)]
    return ids[ragged(start[codes], counts[codes])], edge


def given_back(table: pa.Array, ids: np.ndarray, edge: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the bytes of the tokens are."""
    got, at = flat_bytes(table.take(pa.array(ids)))
    at = at[edge]
    same = np.diff(at) == np.diff(offsets)
    if len(got) == len(data) and same.all():
        differ = np.flatnonzero(got != data)
        same[np.searchsorted(offsets, differ, "right") - 1] = False
        return same
    for k in np.flatnonzero(same):
        same[k] = (got[at[k] : at[k + 1]] == data[offsets[k] : offsets[k + 1]]).all()
    return same


def events(docs: DataFrame, path_a: str, path_b: str, size: int = Sizes().run) -> DataFrame:
    """key (of the row), doc_id, at (byte offset of its first token), side, ids: the runs of both sides of each document;
    one empty run for a document without tokens."""

    def run(batches):
        numbers = block_number()
        for table in blocks_of(batches, size=EVENT_BLOCK):
            told = []
            texts = table.column(1).combine_chunks().fill_null("").cast(pa.large_string())
            raw, at = flat_bytes(texts)
            some = np.diff(at) > 0
            data, offsets = _with_blanks(raw, at, some)
            sides = [side_a(path_a, data, offsets), side_b(path_b, data, offsets)]
            tables = [byte_bpe.token_bytes(path_a), _pieces(path_b)[1]]
            sizes = _sizes(path_a, path_b)
            for t, (ids, edge) in zip(tables, sides):
                some &= given_back(t, ids, edge, data, offsets)
            for k, doc in enumerate(table.column(0).to_pylist()):
                key = next(numbers)
                if not some[k]:
                    told.append((key, doc, 0, A, b""))
                    continue
                for side, (ids, edge) in enumerate(sides):
                    mine, place = ids[edge[k] : edge[k + 1]], 0
                    for i in range(0, len(mine), size):
                        told.append((key, doc, place, side, pack_many(mine[i : i + size])))
                        place += int(sizes[side][mine[i : i + size]].sum()) if len(mine) > size else 0
            for i in range(0, len(told), 4096):
                cols = list(zip(*told[i : i + 4096]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "doc_id", "at", "side", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, doc_id long, at long, side byte, ids binary")


def _with_blanks(raw: np.ndarray, at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, those that are not empty with a blank before."""
    offsets = at + np.r_[0, np.cumsum(some)]
    data = np.full(int(offsets[-1]), 32, np.uint8)
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][some]] = False
    data[keep] = raw
    return data, offsets


# ---------------------------------------------------------------- the sweep


class Swept:
    """What the machine has closed: tokens of both sides up to an offset at which both end, by document."""

    def __init__(self, sizes, keys, docs, last, ids, doc_of):
        self.keys, self.docs, self.last = keys, docs, last  # of each document; whether it ends here
        self.ids, self.doc_of = ids, doc_of  # of each side, of each token
        ends = [np.cumsum(s[x]) for s, x in zip(sizes, ids)]
        # the token of B that is open where a token of A ends, and the other way
        self.open_b = np.searchsorted(ends[B], ends[A], "left")
        self.open_a = np.searchsorted(ends[A], ends[B], "left")
        self.both = ends[B][np.minimum(self.open_b, len(ends[B]) - 1)] == ends[A] if len(ends[B]) else np.zeros(0, bool)
        self.both_b = ends[A][np.minimum(self.open_a, len(ends[A]) - 1)] == ends[B] if len(ends[A]) else np.zeros(0, bool)
        self.ends = ends

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place in A, place in B) of each link: one for each offset at which a token ends."""
        only_b = np.flatnonzero(~self.both_b)
        a = np.r_[np.arange(len(self.open_b)), self.open_a[only_b]]
        b = np.r_[self.open_b, only_b]
        return np.r_[self.doc_of[A], self.doc_of[B][only_b]], a, b

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of the group of each token of A and of B."""
        return tuple(np.cumsum(np.r_[0, x[:-1]])[: len(x)] for x in (self.both, self.both_b))


def sweep(batches, sizes, tokens: int) -> Iterator[Swept]:
    """The machine: runs of a partition sorted by key, at, side in; closed parts of documents out."""
    held: list[tuple] = []  # (key, doc_id, side, ids) not closed yet
    n = 0
    for batch in batches:
        for key, doc, side, blob in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "side", "ids"))):
            ids = unpack_many(blob)[0] if blob else np.zeros(0, np.int64)
            held.append((key, doc, side, ids))
            n += len(ids)
            if n >= tokens:
                closed, held = _close(held, sizes)
                n = sum(len(h[3]) for h in held)
                if closed is not None:
                    yield closed
    if held:
        yield _close(held, sizes, True)[0]


def _close(held, sizes, whole: bool = False):
    """(Swept of what is closed, what goes on). The last document may go on after these runs, the others are complete."""
    keys, docs, rows = [], [], []
    for key, doc, side, ids in held:
        if not keys or keys[-1] != key:
            keys.append(key)
            docs.append(doc)
        rows.append((len(keys) - 1, side, ids))
    ids, doc_of, rest = [], [], []
    for side in (A, B):
        mine = [(d, x) for d, s, x in rows if s == side and len(x)]
        ids.append(np.concatenate([x for _, x in mine]) if mine else np.zeros(0, np.int64))
        doc_of.append(np.repeat([d for d, _ in mine], [len(x) for _, x in mine]).astype(np.int64) if mine else np.zeros(0, np.int64))
    last = np.ones(len(keys), bool)
    if not whole:
        k = len(keys) - 1
        first = [int(np.searchsorted(d, k)) for d in doc_of]
        ends = [np.cumsum(s[x[f:]]) for s, x, f in zip(sizes, ids, first)]
        same = np.intersect1d(*ends, assume_unique=True)
        cut = [f + (int(np.searchsorted(e, same[-1], "right")) if len(same) else 0) for f, e in zip(first, ends)]
        rest = [(keys[k], docs[k], side, ids[side][cut[side] :]) for side in (A, B)]
        ids, doc_of, last[k] = [x[:c] for x, c in zip(ids, cut)], [d[:c] for d, c in zip(doc_of, cut)], False
    return Swept(sizes, np.array(keys), docs, last, ids, doc_of), rest


@cache
def _sizes(path_a: str, path_b: str) -> list[np.ndarray]:
    """Bytes of each token of both sides."""
    return [np.diff(flat_bytes(t)[1]) for t in (byte_bpe.token_bytes(path_a), _pieces(path_b)[1])]


def swept_events(docs: DataFrame, path_a: str, path_b: str, at: Sizes = Sizes()) -> DataFrame:
    """Events, each document's in one partition, in the order of their offsets."""
    arrow_batches(docs.sparkSession)
    n = bucket_count(docs, bucket=at.bucket)
    return events(docs, path_a, path_b, at.run).repartition(n, "key").sortWithinPartitions("key", "at", "side")


def token_groups(docs: DataFrame, path_a: str, path_b: str, size: Sizes = Sizes()) -> DataFrame:
    """doc_id, end_byte (where the group ends in blank + text), a_ids, b_ids of every group of tokens."""

    def run(batches):
        sizes, at = _sizes(path_a, path_b), {}
        for s in sweep(batches, sizes, size.tokens):
            close_a, close_b = np.flatnonzero(s.both), np.flatnonzero(s.both_b)
            doc = s.doc_of[A][close_a]
            # ends count from the first document of the part; those of each from where its own part began
            begin = np.r_[0, s.ends[A]][np.searchsorted(s.doc_of[A], np.arange(len(s.keys)))]
            before = np.array([at.get(k, 0) for k in s.keys.tolist()], np.int64)
            end = s.ends[A][close_a] - begin[doc] + before[doc]
            at = {k: int(v + np.r_[0, s.ends[A]][np.searchsorted(s.doc_of[A], d, "right")] - begin[d]) for d, (k, v, e) in enumerate(zip(s.keys.tolist(), before, s.last)) if not e}
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, c + 1], pa.int32()), pa.array(x, pa.int32())) for c, x in ((close_a, s.ids[A]), (close_b, s.ids[B]))]
            yield pa.RecordBatch.from_arrays([pa.array([s.docs[d] for d in doc.tolist()], pa.int64()), pa.array(end), *lists], ["doc_id", "end_byte", "a_ids", "b_ids"])

    return swept_events(docs, path_a, path_b, size).mapInArrow(run, "doc_id long, end_byte long, a_ids array<int>, b_ids array<int>")


@cache
def _decimals(n: int) -> pa.Array:
    """Decimal strings of 0..n-1 followed by a comma, then by a bar, then by a semicolon."""
    return pa.array([f"{k}{c}".encode() for c in ",|;" for k in range(n)], pa.large_binary())


def _digest_text(s: Swept, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by document) of the groups as text, each with its semicolon."""
    ga, gb = s.groups()
    # a token of A stands after all of B in earlier groups, one of B after all of A in groups up to its own
    order_a = np.arange(len(ga)) + np.searchsorted(gb, ga, "left")
    order_b = np.arange(len(gb)) + np.searchsorted(ga, gb, "right")
    ids = np.empty(len(ga) + len(gb), np.int64)
    ids[order_a] = s.ids[A] + n * s.both  # the last of A in a group is followed by a bar
    ids[order_b] = s.ids[B] + 2 * n * s.both_b
    data, at = flat_bytes(_decimals(n).take(pa.array(ids)))
    edge = sum(np.searchsorted(s.doc_of[side], np.arange(len(s.keys) + 1)) for side in (A, B))
    return data, at[edge]


REPORT = [("doc_ids", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]


class _Block:
    """Documents that are complete, and the pairs each holds, until there are enough of them."""

    def __init__(self):
        self.rows, self.pairs, self.times, self.held = [], [], [], 0

    def packed(self, number: int, buckets: int, splits: int) -> pa.RecordBatch:
        counts = np.array([len(p) for p in self.pairs], np.int64)
        every = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        listed, codes = _factorize(every)
        n_docs = np.bincount(codes, minlength=len(listed))
        bucket = (mix((listed >> 32).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order, parts = by_bucket(bucket, buckets)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        part = number % splits
        sent = [(b * splits + part, pack_pairs(listed[order[i:j]], n_docs[order[i:j]])) for b, i, j in parts]
        # codes of a document rise, so they are held as differences; the first may be below the last of the one before
        where = np.repeat(np.arange(len(counts)), counts)
        o = np.lexsort((rank[codes], where))
        c, first = rank[codes][o], np.cumsum(counts) - counts
        step = np.diff(c, prepend=0)
        step[first[counts > 0]] = c[first[counts > 0]]
        times = (np.concatenate(self.times) if self.times else np.zeros(0, np.int64))[o]
        cols = [pa.array([[r[k] for r in self.rows]], pa.list_(t)) for k, (_, t) in enumerate(REPORT)]
        return pa.RecordBatch.from_arrays([pa.array([number]), *cols, pa.array([pack_many(counts, step, times)], pa.binary()), sent_array([sent])], ["block", *(c for c, _ in REPORT), "held", "sent"])


def pack_pairs(pairs: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs, sorted, and what belongs to each."""
    return pack_many(np.diff(pairs >> 32, prepend=0), pairs & 0xFFFFFFFF, *more)


def unpack_pairs(blob: bytes) -> list[np.ndarray]:
    a, b, *more = unpack_many(blob)
    return [(np.cumsum(a) << 32) | b, *more]


def _factorize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, code of each)."""
    d = pa.array(x).dictionary_encode()
    listed = np.asarray(d.dictionary)
    order = np.argsort(listed)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return listed[order], rank[np.asarray(d.indices)]


def _counted(doc: np.ndarray, pair: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of n documents its distinct pairs and how often it has each."""
    listed, codes = _factorize(pair)
    key = np.sort(doc * max(len(listed), 1) + codes)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)]
    times, key = np.diff(np.r_[first, len(key)]), key[first]
    edge = np.searchsorted(key, np.arange(n + 1) * max(len(listed), 1))
    pairs = listed[key % max(len(listed), 1)] if len(key) else key
    return [(pairs[i:j], times[i:j]) for i, j in zip(edge, edge[1:])]


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, buckets: int, splits: int, size: Sizes = Sizes()) -> DataFrame:
    """Blocks of swept documents: counts and digest of each, its distinct pairs, and the block's pairs for the buckets."""

    def run(batches):
        sizes = _sizes(path_a, path_b)
        n, numbers, block = max(map(len, sizes)), block_number(), _Block()
        going: dict[int, list] = {}  # of the document that goes on: counts, digest, pairs
        for s in sweep(batches, sizes, size.tokens):
            doc, a, b = s.links()
            count = lambda x: np.bincount(x, minlength=len(s.keys)).tolist()
            facts = list(zip(count(s.doc_of[A]), count(s.doc_of[B]), count(s.doc_of[A][s.both]), count(doc)))
            text, at = _digest_text(s, n)
            pairs = _counted(doc, (s.ids[A][a] << 32) | s.ids[B][b], len(s.keys))
            before, going = going, {}
            for k, key in enumerate(s.keys.tolist()):
                state = before.pop(key, None)
                if state is None:
                    state = [np.zeros(4, np.int64), None, [], []]
                state[0] = state[0] + facts[k]
                if at[k] < at[k + 1]:
                    if state[1] is None:
                        state[1] = hashlib.sha256()
                    else:
                        state[1].update(b";")
                    state[1].update(text[at[k] : at[k + 1] - 1])
                state[2].append(pairs[k][0])
                state[3].append(pairs[k][1])
                if len(state[2]) > 8:  # a long document: its pairs are summed as they come
                    state[2:] = ([x] for x in _summed(state[2], state[3]))
                if not s.last[k]:
                    going[key] = state
                    continue
                mine, times = _summed(state[2], state[3]) if len(state[2]) > 1 else (state[2][0], state[3][0])
                block.rows.append((s.docs[k], *state[0].tolist(), state[1].hexdigest() if state[1] else ""))
                block.pairs.append(mine)
                block.times.append(times)
                block.held += len(mine)
                if block.held >= size.pairs:
                    yield block.packed(next(numbers), buckets, splits)
                    block = _Block()
        if block.rows:
            yield block.packed(next(numbers), buckets, splits)

    columns = "doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
    return swept_events(docs, path_a, path_b, size).mapInArrow(run, f"block long, {columns}, held binary, sent array<struct<bucket:int,data:binary>>")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, sum of the counts of each)."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    o = np.argsort(k, kind="stable")
    k, c = k[o], c[o]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[: len(k)]
    return k[first], np.add.reduceat(c, first) if len(k) else c


#: Pairs of a row of counts.
CELL = 1 << 18


def _sum_stream(batches, best: bool):
    """Sorted sums of the packed pairs of a partition, in cells; what is held are its distinct pairs."""
    keys, counts, n = [], [], 0
    for batch in batches:
        for blob in batch.column("data").to_pylist():
            k, c = unpack_pairs(blob)
            keys.append(k)
            counts.append(c)
            n += len(k)
            if n > 2 * CELL + 2 * len(keys[0]):
                keys, counts = ([x] for x in _summed(keys, counts))
                n = len(keys[0])
    if keys:
        k, c = _summed(keys, counts)
        more = []
        if best:  # all pairs of an id are in one bucket
            first = np.flatnonzero(np.r_[True, np.diff(k >> 32) != 0])
            top = np.maximum.reduceat(c, first)
            more = [c == np.repeat(top, np.diff(np.r_[first, len(k)]))]
        for i in range(0, len(k), CELL):
            j = slice(i, i + CELL)
            yield pack_pairs(k[j], c[j], *(m[j] for m in more))


def pair_counts(sent: DataFrame, buckets: int, splits: int) -> DataFrame:
    """bucket, data: packed pairs, in how many documents each is, and whether that is the most of its first id."""

    def partial(batches):
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId() // splits
        for blob in _sum_stream(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "data"])

    def total(batches):
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId()
        for blob in _sum_stream(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "data"])

    some = sent.repartitionById(buckets * splits, F.col("bucket")).select("data").mapInArrow(partial, "bucket int, data binary")
    return some.repartitionById(buckets, F.col("bucket")).select("data").mapInArrow(total, "bucket int, data binary")


def answered_pairs(sent: DataFrame, counts: DataFrame, buckets: int, splits: int) -> DataFrame:
    """block, bucket, data: for each pair that a block asked for its count and whether it is the highest. The counts of
    a bucket (bounded by the vocabularies) come first in each of its parts, then the questions as a stream."""
    facts = counts.select(F.lit(None).cast("long").alias("block"), F.explode(F.sequence(F.col("bucket") * splits, F.col("bucket") * splits + (splits - 1))).alias("bucket"), "data")
    rows = facts.unionByName(sent.select("block", "bucket", "data")).repartitionById(buckets * splits, F.col("bucket")).sortWithinPartitions(F.col("block").asc_nulls_first())

    def run(batches):
        cells, known = [], None
        for batch in batches:
            told = []
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                if block is None:
                    cells.append(unpack_pairs(blob))
                    continue
                if known is None:
                    o = np.argsort(np.array([c[0][0] for c in cells]))
                    known = [np.concatenate([cells[i][j] for i in o]) for j in range(3)]
                at = np.searchsorted(known[0], unpack_pairs(blob)[0])
                told.append((block, pack_many(known[1][at], known[2][at])))
            if told:
                blocks, blobs = zip(*told)
                bucket = [b for b, k in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()) if k is not None]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(bucket, pa.int32()), pa.array(blobs, pa.binary())], ["block", "bucket", "data"])

    return rows.mapInArrow(run, "block long, bucket int, data binary")


def alignment_report(docs: DataFrame, path_a: str, path_b: str, size: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    n = bucket_count(docs, bucket=size.bucket)
    buckets = min(n, size.buckets)
    splits = -(-n // buckets)
    blocks = materialize(aligned_blocks(docs, path_a, path_b, buckets, splits, size), "align")
    sent = blocks.select("block", F.explode("sent").alias("_s")).select("block", "_s.bucket", "_s.data")
    counts = materialize(pair_counts(sent, buckets, splits), "align")
    told = answered_pairs(sent, counts, buckets, splits)
    whole = to_blocks(blocks.drop("sent"), told)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts, step, times = unpack_many(row["held"])
                first = np.cumsum(counts) - counts
                c = np.cumsum(step)
                before = np.r_[0, c][first]  # differences go on over documents, codes begin anew
                c = c - np.repeat(before, counts)
                answers = [unpack_many(a["data"]) for a in row["answers"] or ()]
                count, best = (np.concatenate([a[k] for a in answers]) if answers else np.zeros(0, np.int64) for k in (0, 1))
                sums = [np.r_[0, np.cumsum(x[c] * times)] for x in (best, count)]
                n_best, count_sum = (s[first + counts] - s[first] for s in sums)
                cols = [row[k] for k in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(n_best), pa.array(count_sum), pa.array(row["groups_sha256"], pa.string())], names)

    return whole.mapInArrow(run, ", ".join(f"{k} long" for k in names[:-1]) + ", groups_sha256 string")
