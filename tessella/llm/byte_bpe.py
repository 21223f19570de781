"""Byte-level BPE over a corpus: each distinct word is encoded once.

The pattern cuts every text into words, without gaps. The words of a block of documents are a dictionary
and a code for each position; dictionaries are shuffled by the hash of the word (`lexicon`), each bucket
encodes each of its distinct words once and sends the ids back, and the ids of a text are put together
by position. Decoding joins the ids with the token-byte table, which has a row for each entry of the
vocabulary and is broadcast.

Cases: null text is empty and has no ids; a text without white space is one word, however long; equal
rows give equal rows; rows with a null id are encoded as all others; an empty table gives no rows;
further columns are ignored, whatever their names. Ids that the table lacks, and null ids, decode to no
bytes; a null list decodes to the empty string of bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import arrow_batches, span_hash
from .lexicon import block_number, blocks_of, bucket_count, by_bucket, flat_bytes, pack_ints, pack_many, pack_words, pattern_cuts, ragged, sent_array, spans, to_blocks, to_buckets, unpack_ints, unpack_many, unpack_words, write_bucketed

#: Words of the documents that are put together at a time.
PART = 1 << 17
BLOCKS = "block long, doc_ids array<long>, n_words binary, codes binary, slots binary, sent array<struct<bucket:int,data:binary>>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


@cache
def token_bytes(path: str) -> pa.Array:
    """The token-byte table: bytes by id."""
    ranks = read_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1 if ranks else 0)
    for token, k in ranks.items():
        out[k] = token
    return pa.array(out, pa.large_binary())


def encode_words(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, number of ids of each) of single words."""
    enc = encoder(path)
    ids = [enc.encode_ordinary(w.decode()) for w in words]
    return np.fromiter((i for x in ids for i in x), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def word_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of documents: word counts of each, a code for each word (by falling frequency), and the dictionary
    in parts for the buckets, with the codes (slots) in the order in which the buckets answer."""

    def run(batches):
        number = block_number()
        for table in blocks_of(batches):
            data, offsets = flat_bytes(table.column(1).combine_chunks())
            cuts = pattern_cuts(data, offsets)
            words = spans(data, cuts).dictionary_encode()
            codes = np.asarray(words.indices)
            often = np.bincount(codes, minlength=len(words.dictionary))
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            listed = words.dictionary.take(pa.array(order))
            raw, at = flat_bytes(listed)
            slots, parts = by_bucket((span_hash(raw, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int64), buckets)
            sent = [(b, pack_words(listed.take(pa.array(slots[i:j])))) for b, i, j in parts]
            n_words = np.diff(np.searchsorted(cuts, offsets))
            yield pa.RecordBatch.from_arrays([
                pa.array([next(number)]), pa.array([table.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([pack_ints(n_words)]),
                pa.array([pack_ints(rank[codes])]), pa.array([pack_ints(slots)]), sent_array([sent]),
            ], ["block", "doc_ids", "n_words", "codes", "slots", "sent"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCKS)


def encoded_words(sent: DataFrame, path: str) -> DataFrame:
    """block, bucket, data: ids of the words that each block asked for. A bucket's task meets its rows as a stream,
    keeps the ids of the words it has met and encodes a word when it meets it first."""

    def run(batches):
        known: dict[bytes, int] = {}
        flat, starts = array("I"), array("q", [0])

        def answer(words: np.ndarray) -> bytes:
            at, ids = np.frombuffer(starts, np.int64), np.frombuffer(flat, np.uint32)
            counts = at[words + 1] - at[words]
            return pack_many(counts, ids[ragged(at[words], counts)] if len(ids) else ids)

        for batch in batches:
            if not batch.num_rows:
                continue
            asked = [unpack_words(b) for b in batch.column("data").to_pylist()]
            words = pa.concat_arrays(asked).dictionary_encode()
            listed = words.dictionary.to_pylist()
            new = [w for w in listed if w not in known]
            ids, counts = encode_words(path, new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            flat.frombytes(ids.astype(np.uint32).tobytes())
            starts.frombytes((starts[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
            met = np.fromiter((known[w] for w in listed), np.int64, len(listed))[np.asarray(words.indices)]
            edge = np.cumsum([0, *map(len, asked)])
            told = [answer(met[i:j]) for i, j in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(told, pa.binary())], ["block", "bucket", "data"])

    return sent.mapInArrow(run, "block long, bucket int, data binary")


def answered_blocks(docs: DataFrame, path: str) -> DataFrame:
    """Blocks of documents with the ids of their words."""
    arrow_batches(docs.sparkSession)
    buckets = bucket_count(docs)
    blocks, _ = write_bucketed(word_blocks(docs, buckets), "block", "bpe")
    told = encoded_words(to_buckets(blocks, "sent", buckets), path)
    return to_blocks(blocks.drop("sent"), told).select("doc_ids", "n_words", "codes", "slots", "answers")


def put_together(batches) -> Iterator[pa.RecordBatch]:
    """doc_id, ids of the documents of answered blocks: the ids of each word at its positions."""
    for batch in batches:
        for row in batch.to_pylist():
            codes, slots = unpack_ints(row["codes"]), unpack_ints(row["slots"])
            answers = [unpack_many(a["data"]) for a in row["answers"] or ()]
            count, start = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
            flat = np.concatenate([a[1] for a in answers]).astype(np.int32) if answers else np.zeros(0, np.int32)
            if answers:
                count[slots] = (n := np.concatenate([a[0] for a in answers]))
                start[slots] = np.cumsum(n) - n
            words = np.r_[0, np.cumsum(unpack_ints(row["n_words"]))]
            first, n = 0, len(row["doc_ids"])
            while first < n:  # documents of about PART words at a time
                last = min(n, max(first + 1, int(np.searchsorted(words, words[first] + PART, "right")) - 1))
                some = codes[words[first] : words[last]]
                edge = np.r_[0, np.cumsum(count[some])][words[first : last + 1] - words[first]]
                ids = flat[ragged(start[some], count[some])]
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][first:last], pa.int64()), lists], ["doc_id", "ids"])
                first = last


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every text, by the rank file at path."""
    return answered_blocks(docs, path).mapInArrow(put_together, "doc_id long, ids array<int>")


def _decoded(ids: pa.Array, table: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, their offsets by row, bytes, their offsets by row) of a column of lists."""
    counts = np.asarray(ids.value_lengths().fill_null(0)).astype(np.int64)
    flat = ids.flatten()
    known = np.asarray(flat.fill_null(-1)).astype(np.int64)
    at = pa.array(known, mask=(known < 0) | (known >= len(table)))
    data, offsets = flat_bytes(table.take(at))
    edge = np.r_[0, np.cumsum(counts)]
    return known, edge, data, offsets[edge]


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded (binary): the bytes of the tokens of each list of ids, joined from the broadcast table."""
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(path))

    def run(batches):
        for batch in batches:
            _, _, data, offsets = _decoded(batch.column(1), table.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans(data, offsets).cast(pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def roundtrip_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids of every text and of the bytes they decode to."""
    table = docs.sparkSession.sparkContext.broadcast(token_bytes(path))

    def run(batches):
        for batch in put_together(batches):  # in the same worker
            ids, edge, data, offsets = _decoded(batch.column(1), table.value)
            ids = ids.astype("<u4")
            told = [hashlib.sha256(ids[i:j].tobytes()).hexdigest() for i, j in zip(edge, edge[1:])]
            back = [hashlib.sha256(data[i:j].tobytes()).hexdigest() for i, j in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(edge)), pa.array(told, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return answered_blocks(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
