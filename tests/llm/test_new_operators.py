"""Byte-level BPE, centroid clustering and alignment of tokenizers against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tessella.llm import alignment, byte_bpe, delta_lloyd, lexicon
from tessella.llm.queries import PIECES, RANKS, tokenizer_path

from . import brute

RANK_FILE, PIECE_FILE = tokenizer_path(RANKS), tokenizer_path(PIECES)
SCHEMA = "doc_id long, text string, ids array<string>, block string, bucket int, key string, side double, row string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ["x"], "b", 1, "k", 0.5, "r", "v") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    odd = ["a", "'s", "'ll", "'", "don't", " ", "  ", "\n", "\t", "é", "漢字", "😀", "12", "½", "　", "́", "!?", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\x1c", "thin", "ere"]
    out = [(0, None), (1, ""), (2, " "), (3, "▁a b"), (4, "word " * 3), (5, "word " * 3), (5, "word " * 3), (6, "x" * 30_000), (7, " \n\n  x"), (None, "no id"), (2**62, "far")]
    out += [(k, "".join(rng.choice(odd) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 60)))) for k in range(10, 80)]
    out += [(k, "the common words of every text " * rng.randrange(1, 9)) for k in range(80, 140)]
    out.append((200, " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000))))
    return out


def test_cuts_are_the_matches_of_the_pattern():
    import regex

    rng = random.Random(1)
    odd = ["a", "s", "t", "'", "'", "re", "ll", "ve", "d", "m", " ", " ", "  ", "\n", "\t", "　", "\x1c", "\x85", "1", "²", "é", "漢", "́", "😀", "!", "?", "R", "S", "ſ", "K"]
    for _ in range(3000):
        texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(0, 5))]
        data, offsets = lexicon.flat_bytes(pa.array(texts, pa.string()))
        cuts = lexicon.pattern_cuts(data, offsets)
        have = [bytes(data[i:j]).decode() for i, j in zip(cuts, cuts[1:])]
        assert have == [m for t in texts for m in regex.findall(public_tokenizers.PATTERN, t)]


def test_packed_columns_come_back():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), np.array([0]), np.array([255, 256, 1 << 40]), rng.integers(0, 70_000, 5000)):
        assert (lexicon.unpack_ints(lexicon.pack_ints(x)) == x).all()
    words = pa.array([b"", b"ab", "é".encode()], pa.large_binary())
    assert lexicon.unpack_words(lexicon.pack_words(words)).to_pylist() == words.to_pylist()


def test_bpe_equals_merges_by_rank(spark, rows):
    small = [(i, t) for i, t in rows if t is None or len(t) < 5000]
    ranks = byte_bpe.read_ranks(RANK_FILE)
    want = brute.byte_bpe(list(enumerate(t for _, t in small)), ranks, public_tokenizers.PATTERN)
    have = sorted((str(r.doc_id), tuple(r.ids)) for r in byte_bpe.encode_documents(frame(spark, small), RANK_FILE).collect())
    assert have == sorted((str(i), tuple(want[k][0])) for k, (i, _) in enumerate(small))


def test_bpe_round_trip_of_whole_texts(spark, rows):
    enc = byte_bpe.encoder(RANK_FILE)
    want = sorted((str(i), len(x := enc.encode_ordinary(t or "")), brute.sha(np.array(x, "<u4").tobytes()), brute.sha((t or "").encode())) for i, t in rows)
    have = sorted((str(r[0]), *r[1:]) for r in byte_bpe.roundtrip_report(frame(spark, rows), RANK_FILE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert have == want
    for t in ("<|endoftext|>", "a<|endoftext|>b"):
        assert enc.encode_ordinary(t) == brute.byte_bpe([(0, t)], byte_bpe.read_ranks(RANK_FILE), public_tokenizers.PATTERN)[0][0]
    empty = frame(spark, rows).where("false")
    assert byte_bpe.roundtrip_report(empty, RANK_FILE).count() == 0


def test_decoding_leaves_out_what_the_table_lacks(spark):
    df = spark.createDataFrame([(1, [0, 10**9, None, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    table = byte_bpe.token_bytes(RANK_FILE)
    have = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode_documents(df, RANK_FILE).collect()}
    assert have == {1: table[0].as_py() + table[1].as_py(), 2: b"", 3: b""}


# ---------------------------------------------------------------- clusters


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, "clash", 1, 2.0) for i, x in rows], "vec_id long, embedding array<float>, row string, owner int, v double").repartition(3)


def test_delta_lloyd_equals_lloyd(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (9, 64))
    rows = [(k, (centres[k % 9] + rng.normal(0, 0.1, 64)).astype(np.float32).tolist()) for k in range(700)]
    rows += [(700, None), (701, [0.1] * 63), (702, [0.1] * 65), (703, [0.1] * 63 + [None]), (704, [0.1] * 63 + [math.nan]), (705, [math.inf] * 64), (706, [])]
    rows += [(k, [0.0] * 64) for k in range(710, 760)] + [(5, rows[5][1]), (5, [0.5] * 64), (None, [-0.5] * 64), (800, [1000.0] * 64)]
    told, centres = brute.lloyd([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows])
    per = {}
    for _, c, d in told:
        per[c] = per.get(c, 0) + d
    total = sum(per.values())
    want = sorted((str(i), c, d, per[c], total, brute.sha(",".join(map(str, centres[c])).encode())) for i, c, d in told)
    df = delta_lloyd.cluster_vectors(vectors(spark, rows))
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in df.collect()) == want


def test_delta_lloyd_few_or_no_vectors(spark):
    assert delta_lloyd.cluster_vectors(vectors(spark, [(1, None)])).count() == 0
    assert delta_lloyd.cluster_vectors(vectors(spark, [(1, None)]).where("false")).count() == 0
    same = delta_lloyd.cluster_vectors(vectors(spark, [(k, [0.25] * 64) for k in range(5)])).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in same} == {(0, 0, 0)}


def test_only_changed_centroids_and_moved_owners_are_compared():
    rng = np.random.default_rng(4)
    v = rng.integers(-60, 60, (500, 8))
    c = rng.integers(-60, 60, (12, 8))
    none = np.full(500, -1), np.zeros(500, np.int64)
    owner, distance = delta_lloyd.assign(v, *none, c, np.arange(12))
    for changed in ([3], [0, 11], [], list(range(12))):
        new = c.copy()
        new[changed] += rng.integers(-9, 9, (len(changed), 8))
        delta = delta_lloyd.assign(v, owner, distance, new, np.array(changed, np.int64))
        fresh = delta_lloyd.assign(v, *none, new, np.arange(12))
        assert (delta[0] == fresh[0]).all() and (delta[1] == fresh[1]).all()
        c, (owner, distance) = new, delta
    big = v * (1 << 20)
    assert (delta_lloyd.squared_distances(big, big[:5]) == np.array([[int(((a - b) ** 2).sum()) for b in big[:5]] for a in big])).all()


# ---------------------------------------------------------------- alignment


def plain_alignment(rows):
    model, _, _ = alignment._pieces(PIECE_FILE)
    table_a, table_b = byte_bpe.token_bytes(RANK_FILE), alignment._pieces(PIECE_FILE)[1]
    enc = byte_bpe.encoder(RANK_FILE)
    return brute.alignment(rows, enc.encode_ordinary, lambda k: table_a[k].as_py(), lambda t: model.encode(t), lambda k: table_b[k].as_py())


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size", [alignment.Sizes(), alignment.Sizes(7, 40, 300, 20_000, 3)])
def test_alignment_equals_token_by_token(spark, rows, size):
    """Also with runs, buffers, blocks and buckets so small that documents go on over many of them."""
    small = [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in rows]
    want = sorted((str(r[0]), *r[1:]) for r in plain_alignment(small))
    have = alignment.alignment_report(frame(spark, small), RANK_FILE, PIECE_FILE, size).select(*NAMES).collect()
    assert sorted((str(r[0]), *r[1:]) for r in have) == want


@pytest.mark.parametrize("size", [alignment.Sizes(), alignment.Sizes(50, 300)])
def test_alignment_groups_are_the_tokens(spark, rows, size):
    some = [(k, t) for k, (i, t) in enumerate(rows) if t is None or len(t) < 5000]
    groups = alignment.token_groups(frame(spark, some), RANK_FILE, PIECE_FILE, size).collect()
    by = {}
    for r in sorted(groups, key=lambda r: (r.doc_id, r.end_byte)):
        by.setdefault(r.doc_id, []).append(r)
    model, table, _ = alignment._pieces(PIECE_FILE)
    enc = byte_bpe.encoder(RANK_FILE)
    for k, t in some:
        if not t or "▁" in t:
            assert k not in by
            continue
        assert [x for r in by[k] for x in r.a_ids] == enc.encode_ordinary(" " + t)
        assert [x for r in by[k] for x in r.b_ids] == model.encode(t)
        assert by[k][-1].end_byte == len((" " + t).encode())


def test_parts_give_the_ids_of_the_whole_text(rows):
    model, _, splits = alignment._pieces(PIECE_FILE)
    assert splits
    texts = [t for _, t in rows if t]
    data, offsets = lexicon.flat_bytes(pa.array([" " + t for t in texts], pa.string()))
    ids, edge = alignment.side_b(PIECE_FILE, data, offsets)
    for k, t in enumerate(texts):
        assert ids[edge[k] : edge[k + 1]].tolist() == model.encode(t)


def test_alignment_of_an_empty_table(spark, rows):
    assert alignment.alignment_report(frame(spark, rows).where("false"), RANK_FILE, PIECE_FILE).count() == 0
    only = alignment.alignment_report(frame(spark, [(1, None), (2, "")]), RANK_FILE, PIECE_FILE).select(*NAMES).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# ---------------------------------------------------------------- hashes that decide

#: Words of equal span_hash() without a key: the second 8 bytes are solved for.
CHAINED = 'tf]35#&",rgy]d}l', "z3&gix2^y1?13{>l"


def test_words_made_to_collide_are_not_taken_for_equal(spark):
    from tessella.llm import core, minhash, substring_dedup, suffix_dedup

    data = np.frombuffer("".join(CHAINED).encode(), np.uint8)
    at = np.array([0, 16])
    plain = core.span_hash(data, at, at + 16)
    assert plain[0] == plain[1]
    core.arrow_batches(spark)
    keyed = core.span_hash(data, at, at + 16, core.run_key())
    assert core.run_key() and keyed[0] != keyed[1]
    a, b = (" ".join([w] * 20) for w in CHAINED)
    df = spark.createDataFrame([(1, a), (2, b), (3, a + " tail")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}[2] == 2
    rows = df.where("doc_id < 3")
    assert [r.n_removed for r in substring_dedup.removal_report(rows).collect()] == [0, 0]  # windows of no document with a smaller id
    own = brute.repeated_bytes([(1, a), (2, b)])
    assert {r.doc_id: r.n_removed for r in suffix_dedup.removal_report(rows).collect()} == {i: sum(own[i][1]) for i in (1, 2)}
