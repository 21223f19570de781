from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import (
    chat,
    core,
    embed_dedup,
    fingerprints,
    minhash,
    mixing,
    packing,
    quality,
    queries,
    substring_dedup,
    suffix_dedup,
    url_filters,
    winnow,
)

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, bucket int, rep long, _id string, size double"


def prose(rng, n, base=400):
    return " ".join(f"w{rng.randrange(base)}{'.' if rng.random() < .1 else ''}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = prose(rng, 40)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two three"), (5, "one two three"), (6, "é" * 130), (7, "x" * 700), (8, "x" * 350 + "y"), (9, "a b " * 200)]
    base = prose(rng, 200)
    for k in range(10, 60):
        r = rng.random()
        if r < 0.25:
            text = base
        elif r < 0.5:
            w = base.split(" ")
            for _ in range(rng.randrange(1, 14)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
            text = " ".join(w)
        elif r < 0.75:
            text = prose(rng, rng.randrange(5, 60)) + " " + passage + " " + prose(rng, rng.randrange(0, 60))
        else:
            text = prose(rng, rng.randrange(0, 400)) + "\nÜber ß 漢字 😀 " + prose(rng, 20)
        out.append((k, text))
    out.append((60, prose(rng, 30_000, 9000)))
    out.append((61, out[-1][1][5000:20_000] + " tail"))
    return out


def frame(spark, rows, extra=()):
    full = [(i, t, "en" if i is not None and i % 2 else None, None if i is None or i % 5 == 0 else f"s{i % 3}", None, "clash", 1, 2, "z", 0.5) for i, t in [*rows, *extra]]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def got(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *cols).collect()}


# ---------------------------------------------------------------- shared pieces


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 500)]
    want = brute.components({x for p in pairs for x in p}, pairs)
    df = core.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    have = {r.node: r.component for r in df.collect()}
    assert have == {n: c for n, c in want.items() if n in have}
    assert all(c == n for n, c in want.items() if n not in have)
    assert core.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_match_the_pattern():
    texts = ["", " a\x0bb ", "x", "é\u00a0z q", "a\x1cb", "\n\n", "end "]
    import pyarrow as pa

    found = []
    for i, j, data, offs in core.text_blocks(pa.array(texts)):
        s, e, row, _ = core.words(data, offs)
        found += [(i + r, bytes(data[a:b]).decode()) for a, b, r in zip(s, e, row)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in brute.WORD.findall(t)]


# ---------------------------------------------------------------- 1 packing


def test_packing_places_every_piece(spark, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [*rows, (70, "a <|endoftext|> b"), (70, "a <|endoftext|> b"), (None, "no id")]
    out = packing.pack_documents(frame(spark, texts), path, 256).collect()
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in out)
    assert len(seqs) <= -(-total // 256) * 1.03 + 1
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_plan_places_exactly_the_histogram():
    rng = random.Random(5)
    for size, n in ((64, 500), (100, 3000), (16, 7)):
        hist = {}
        for _ in range(n):
            k = rng.choice([rng.randrange(1, size + 1), size // 2 + 1, size // 3])
            hist[k] = hist.get(k, 0) + 1
        plan, bound, _ = packing.plan_packing(hist, size)
        placed = {}
        for lengths, counts, times in plan:
            assert (lengths * counts).sum() <= size
            for a, b in zip(lengths.tolist(), counts.tolist()):
                placed[a] = placed.get(a, 0) + b * times
        assert placed == hist
        used = sum(t for _, _, t in plan)
        left = np.zeros(size + 1, int)
        for k, v in hist.items():
            left[k] = v
        best_fit = sum(t for _, _, t in packing.best_fit(left, size))
        assert bound <= used <= best_fit


def histogram(draw, n):
    out = {}
    for _ in range(n):
        k = draw()
        out[k] = out.get(k, 0) + 1
    return out


@pytest.mark.parametrize(("name", "above"), [("lognormal", 1.002), ("large", 1.002), ("middle", 1.002), ("mixed", 1.05)])
def test_program_places_most_pieces_near_its_bound(name, above):
    rng = random.Random(9)
    draw = {
        "lognormal": lambda: min(2048, int(rng.lognormvariate(6, 1)) + 1), "large": lambda: rng.randrange(1100, 2048),
        "middle": lambda: rng.randrange(690, 1001), "mixed": lambda: rng.choice([rng.randrange(1, 2049), rng.randrange(600, 800)]),
    }[name]
    one = histogram(draw, 20_000)
    for times in (1, 1000):
        hist = {k: n * times for k, n in one.items()}
        plan, bound, placed = packing.plan_packing(hist)
        done = {}
        for lengths, counts, n in plan:
            assert (lengths * counts).sum() <= 2048
            for a, b in zip(lengths.tolist(), counts.tolist()):
                done[a] = done.get(a, 0) + b * n
        assert done == hist
        assert placed >= 0.9 * sum(hist.values())
        assert bound <= sum(n for _, _, n in plan) <= bound * above + 2
        assert len(plan) < 40_000  # the plan does not grow with the pieces


def plain_best_fit(hist, size=2048):
    """Best fit decreasing, piece by piece."""
    room = []
    for length in sorted(hist, reverse=True):
        for _ in range(hist[length]):
            fits = [(r, k) for k, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(size - length)
    return len(room)


def test_best_fit_of_a_histogram_is_that_of_its_pieces():
    rng = random.Random(8)
    for _ in range(60):
        hist = {rng.randrange(1, 2049): rng.randrange(1, 9) for _ in range(rng.randrange(1, 40))}
        need = np.zeros(2049, np.int64)
        for k, n in hist.items():
            need[k] = n
        plan = packing.best_fit(need, 2048)
        assert sum(t for _, _, t in plan) == plain_best_fit(hist)
        done = {}
        for lengths, counts, t in plan:
            assert (lengths * counts).sum() <= 2048
            for a, b in zip(lengths.tolist(), counts.tolist()):
                done[a] = done.get(a, 0) + b * t
        assert done == hist


#: Ranges and sets of lengths that are narrow or few, for which the program is hard.
HARD = [range(500, 683), range(495, 669), range(400, 512), range(334, 446), range(250, 293), (682, 683, 684), (245, 387, 812, 863, 1179, 1433), (1000, 524, 512, 300, 1100), (700,), (2047,), (1, 2047), (1024, 1025)]


@pytest.mark.parametrize("lengths", HARD, ids=str)
@pytest.mark.parametrize("times", [1, 1000])
def test_narrow_histograms_are_never_packed_worse_than_best_fit(lengths, times):
    rng = random.Random(6)
    hist = {k: (rng.randrange(1, 20)) * times for k in lengths}
    need = np.zeros(2049, np.int64)
    for k, n in hist.items():
        need[k] = n
    plan, bound, _ = packing.plan_packing(hist)
    done = {}
    for ls, cs, t in plan:
        assert (ls * cs).sum() <= 2048
        for a, b in zip(ls.tolist(), cs.tolist()):
            done[a] = done.get(a, 0) + b * t
    assert done == hist
    assert bound <= sum(t for _, _, t in plan) <= sum(t for _, _, t in packing.best_fit(need, 2048))


def test_program_is_solved_to_its_gap():
    need = np.zeros(2049, np.int64)
    rng = random.Random(4)
    for k, n in histogram(lambda: min(2047, int(rng.lognormvariate(6, 1)) + 1), 30_000).items():
        need[k] = n
    _, value, bound = packing.solve_program(need)
    assert bound <= value <= bound * 1.01


def test_hot_lengths_are_ranked_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 7)
    rows = [(i, 0, 0, rng, i) for i in range(200) for rng in (256, 100 + i % 3)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    seqs = {}
    for r in packing.pack(pieces, 256).collect():
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, seqs.values())) == 400
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(seqs) <= 200 + 100 + 1


# ---------------------------------------------------------------- 2 fingerprints


def plain_fingerprint(text):
    """The definition, one byte at a time."""
    b = text.encode()
    mask = 0xFFFFFFFF
    muls = [0x9E3779B1]
    for _ in range(6):
        muls.append(muls[-1] * 0x85EBCA6B & mask)

    def roll(i):
        h = 0
        for back in range(min(7, i + 1)):
            h ^= (b[i - back] + 1) * muls[back] & mask
        h ^= h >> 15
        h = h * 0x2C1B3C6D & mask
        return h ^ h >> 13

    rolls = [roll(i) for i in range(len(b))]
    P, M = 0xFF51AFD7ED558CCD, (1 << 64) - 1

    def signature(size):
        out, start = "", 0
        for i in range(len(b)):
            if rolls[i] % size == size - 1 or i == len(b) - 1:
                h, p = 0, 1
                for x in b[start : i + 1]:
                    h = (h + (x + 1) * p) & M
                    p = p * P & M
                h ^= h >> 29
                h = h * 0xBF58476D1CE4E5B9 & M
                out += chr(fingerprints._CHARS[h >> 58])
                start = i + 1
        if len(out) > 64:
            out = out[:63] + fingerprints._fold(out[63:].encode()).decode()
        return out

    size = 3
    while len(b) > size * 64:
        size *= 2
    while size > 3 and len(signature(size)) < 32:
        size //= 2
    return f"{size}:{signature(size)}:{signature(2 * size)}"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_likeness(p, q):
    if p == q:
        return 1.0
    (i, a1, a2), (j, b1, b2) = p.split(":"), q.split(":")
    pairs = [(a1, b1), (a2, b2)] if i == j else [(a1, b2)] if int(i) == 2 * int(j) else [(a2, b1)] if int(j) == 2 * int(i) else []
    best = 0.0
    for a, b in pairs:
        g = min(4, len(a), len(b))
        if g and {a[k : k + g] for k in range(len(a) - g + 1)} & {b[k : k + g] for k in range(len(b) - g + 1)}:
            best = max(best, 2 * lcs(a, b) / (len(a) + len(b)))
    return best


def test_fingerprints(spark, rows):
    short = [(i, t if t is None else t[:3000]) for i, t in rows]
    have = got(fingerprints.compare_neighbours(frame(spark, short)), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    order = sorted(short, reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(nxt)
        n, sha, fp, efp, ne, nn = have[i]
        assert (n, sha, fp, efp) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b), i
        assert ne == pytest.approx(plain_likeness(a, b)) and nn == pytest.approx(plain_likeness(a, c))
    assert fingerprints.compare_neighbours(frame(spark, [])).count() == 0
    one = fingerprints.compare_neighbours(frame(spark, [(1, "abc")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    again = fingerprints.fingerprint(frame(spark, short))
    assert {r.doc_id: r.fingerprint for r in again.select("doc_id", "fingerprint").collect()} == {i: v[2] for i, v in have.items()}


# ---------------------------------------------------------------- 3 chat


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo <|end|>"), (1, 2, "user", None), (1, 2, "eve", "x"), (1, None, None, "late"), (2, 0, "solo", ""), (None, 0, "a", "b"), (1, 1, "bot", "yo <|end|>")]
    df = spark.createDataFrame([(*t, 1, "p") for t in turns], "conv_id long, turn long, role string, text string, pid int, perspective string")
    out = chat.perspectives(df).collect()
    clean = [(c, t, r or "unknown", (x or "").replace("<|", "< |")) for c, t, r, x in turns]
    want = []
    for c in {x[0] for x in clean}:
        own = sorted((x for x in clean if x[0] == c), key=lambda x: (x[1] is None, x[1] or 0, x[2], hashlib.md5(x[3].encode()).hexdigest()))
        for who in {x[2] for x in own}:
            at = 0
            for _, t, r, x in own:
                head = "<|assistant|>\n" if r == who else f"<|user:{r}|>\n"
                seg = head + x + "<|end|>\n"
                want.append((c, who, t, r, "assistant" if r == who else "user", seg, at, at + len(head) if r == who else None, at + len(seg) - 1 if r == who else None))
                at += len(seg)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert chat.perspectives(df.where("false")).count() == 0


# ---------------------------------------------------------------- 4 embeddings


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings(spark, kind):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 24))
    vecs = np.concatenate([c + 0.3 * rng.standard_normal((25, 24)) for c in centres] + [rng.standard_normal((200, 24))])
    vecs = vecs.astype(np.float32).astype(float) if kind == "float" else vecs
    data = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(600 + i, vecs[0].tolist()) for i in range(40)] + [(700, (vecs[0] * 2).tolist())]
    odd = [(800, None), (801, [0.0] * 24), (802, [1.0, None] * 12), (803, [float("nan")] * 24), (804, [float("inf")] * 24), (805, []), (806, [1.0, 2.0]), (807, [1.0, 2.0]), (None, vecs[0].tolist())]
    df = spark.createDataFrame([(*r, 7, 1) for r in data + odd], f"vec_id long, embedding array<{kind}>, label int, mult int")
    have = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_embeddings(df).collect()}
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.9
    np.fill_diagonal(close, False)
    ids = [i for i, _ in data]
    comp = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))])
    want = {i: (int(close[k].sum()), comp[i], comp[i] == i) for k, i in enumerate(ids)}
    want |= {i: (0, i, True) for i in (800, 801, 802, 803, 804, 805)} | {806: (1, 806, True), 807: (1, 806, False), None: (0, None, True)}
    links = sum(v[0] for v in want.values())
    assert sum(have[i][0] for i in want) >= 0.99 * links and all(have[i][0] <= want[i][0] for i in want)
    assert [i for i in want if have[i][1:] != want[i][1:]] == []
    assert embed_dedup.near_embeddings(df.where("false")).count() == 0


@pytest.mark.parametrize(("dim", "n"), [
    (64, 2_000), (64, 100_000), (64, 1_000_000), (64, 100_000_000), (24, 10_000), (24, 1_000_000), (24, 100_000_000), (128, 100_000_000),
    (768, 1_000_000), (768, 100_000_000), (16, 1_000_000), (2, 1_000_000), (1, 1_000_000)])
def test_isolated_pairs_meet_at_every_number_of_vectors(dim, n):
    code, rng = embed_dedup.ProductCode(dim, n), np.random.default_rng(7)
    for rho in (0.9, 0.92, 0.95):
        pairs = 1000 if dim < 500 else 200
        (r, f), (q, g) = (code.decode(v) for v in embed_dedup.random_pairs(rng, pairs, dim, rho))
        met = set(zip(r.tolist(), f.tolist())) & set(zip(q.tolist(), g.tolist()))
        assert len({row for row, _ in met}) == pairs


def test_planted_partners_among_many_vectors(spark):
    rng = np.random.default_rng(11)
    x, y = embed_dedup.random_pairs(rng, 500, 24, 0.902)
    noise = rng.standard_normal((19_000, 24))
    vecs = np.concatenate([x, y, noise / np.linalg.norm(noise, axis=1, keepdims=True)])
    close = set()
    for lo in range(0, len(vecs), 2000):
        i, j = np.nonzero(vecs[lo : lo + 2000] @ vecs.T >= 0.9)
        close |= {(a + lo, b) for a, b in zip(i.tolist(), j.tolist()) if a + lo < b}
    comp = brute.components(range(len(vecs)), close)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    have = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_embeddings(df).collect()}
    assert len(close) >= 500 and sum(v[0] for v in have.values()) >= 0.99 * 2 * len(close)
    assert np.mean([have[i][1] == comp[i] for i in have]) > 0.999


def test_equal_ids_with_different_vectors_are_two_rows(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.1]
    rows = [(5, a), (5, b), (9, c), (7, a), (3, [0.0, 0.0, 1.0]), (5, [0.0, -1.0, 0.0]), (5, b)]
    out = embed_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    have = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out)
    assert have == [(3, 0, 3, True), (5, 0, 5, True), (5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (7, 1, 5, False), (9, 2, 5, False)]


def test_filter_blocks_compare_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal(16) + 0.05 * rng.standard_normal((60, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    assert {(r.n_links, r.component_id) for r in embed_dedup.near_embeddings(df).collect()} == {(59, 0)}


# ---------------------------------------------------------------- 5 near duplicates


def test_near_duplicates(spark, rows):
    have = got(minhash.near_duplicates(frame(spark, rows, [(None, "one two three"), (5, "one two three")])), "n_shingles", "component_id", "kept")
    want = brute.near_duplicates(rows)
    assert have.pop(None)[1:] == (None, True)
    assert {i: v for i, v in have.items()} == want
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_hot_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 120).split(" ")
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(500)}"
        docs.append((i, " ".join(w)))
    for block in (2048, 16):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "VERIFY_BLOCK", block)
        assert got(minhash.near_duplicates(frame(spark, docs)), "n_shingles", "component_id", "kept") == brute.near_duplicates(docs)


def test_least_matches_lose_no_more_than_told():
    rng = np.random.default_rng(1)
    x = rng.random((20_000, minhash.HASHES)) < 0.75
    alive = np.ones(len(x), bool)
    for k, need in enumerate(minhash.least_matches()):
        alive &= x[:, : (k + 1) * minhash.BATCH].sum(1) >= need
    assert alive.mean() > 0.999


def test_drop_keeps_all_columns(spark, rows):
    df = frame(spark, rows)
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {i for i, v in brute.near_duplicates(rows).items() if v[2]}


# ---------------------------------------------------------------- 6 suffix arrays


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    have = got(suffix_dedup.removal_report(frame(spark, rows, [(None, rows[20][1]), rows[30], rows[9]])), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert have.pop(None)[1] == 0
    assert have == brute.suffix_report(rows)
    assert suffix_dedup.removal_report(frame(spark, [])).count() == 0


def test_hot_windows_go_through_bounded_collections(spark, monkeypatch):
    rng = random.Random(31)
    line = prose(rng, 30)
    docs = [(i, f"{prose(rng, 8)} {line} {prose(rng, 8)}") for i in range(90)] + [(200, "z" * 900)]
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 1000)
    for name, value in (("HOT_LEAST", 5), ("HOT_SHARE", 10), ("HINT_OF", 2)):
        monkeypatch.setattr(winnow, name, value)
    assert got(suffix_dedup.removal_report(frame(spark, docs).repartition(30)), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_report(docs)
    data = np.frombuffer((b"x" * 100 + b"y" + b"x" * 100), np.uint8)
    same = suffix_dedup.equal_to_earlier(data, np.array([0, 101, 1]), np.zeros(3, np.uint64), np.array([1, 2, 3]), np.array([0, 0, 0]))
    assert same.tolist() == [False, True, False]


def test_transform_and_common_prefixes():
    rng = random.Random(2)
    docs = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(30)] + [b"abab" * 8, b"abab" * 8]
    offs = np.r_[0, np.cumsum([len(d) for d in docs])]
    bwt, lcp = suffix_dedup.collection_bwt(np.frombuffer(b"".join(docs), np.uint8), offs)
    rows = sorted((d[k:], i, k) for i, d in enumerate(docs) for k in range(len(d) + 1))
    assert bwt.tolist() == [docs[i][k - 1] + 1 if k else 0 for _, i, k in rows]
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist()[1:] == [shared(a[0], b[0]) for a, b in zip(rows, rows[1:])]


def test_removed_text(spark, rows):
    df = frame(spark, rows)
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == df.columns
    want = {i: bytes(x for x, y in zip(b, g) if not y).decode("utf-8", "ignore") for i, (b, g) in brute.repeated_bytes(rows).items()}
    have = {r.doc_id: r.text for r in out.collect()}
    assert have.pop(0) is None and want.pop(0) == ""
    assert have == want


def test_hot_anchors_change_no_result(spark, monkeypatch):
    rng = random.Random(21)
    passage = prose(rng, 25)
    docs = [(i, prose(rng, 15) + " " + passage + " " + prose(rng, rng.randrange(3, 15))) for i in range(120)]
    df = frame(spark, docs)
    for name, value in (("HOT_LEAST", 5), ("HOT_SHARE", 10), ("HINT_OF", 2)):
        monkeypatch.setattr(winnow, name, value)
    assert len(winnow.hot_anchors(df, suffix_dedup.SPEC)) and len(winnow.hot_anchors(df, substring_dedup.SPEC))
    assert got(suffix_dedup.removal_report(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_report(docs)
    for batches in (1, 3):
        assert got(substring_dedup.removal_report(df, batches), "n_words", "n_removed", "kept_sha256") == brute.repeated_words(docs)


def test_a_text_longer_than_a_block(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(5000)}" for _ in range(230_000)]
    docs = [(1, " ".join(words)), (2, "short one"), (3, " ".join(words[:-40_000]) + " other end")]
    assert len(docs[0][1]) > core.BLOCK_BYTES
    df = frame(spark, docs)
    assert got(minhash.near_duplicates(df), "n_shingles", "component_id", "kept") == brute.near_duplicates(docs)
    assert got(substring_dedup.removal_report(df), "n_words", "n_removed", "kept_sha256") == brute.repeated_words(docs)
    assert got(suffix_dedup.removal_report(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_report(docs)
    assert fingerprints.compare_neighbours(df).count() == 3
    out = packing.pack_documents(df, queries.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("m")).collect()
    assert len(out) == 3 and max(r.m for r in out) == 2048


# ---------------------------------------------------------------- 7 quality


def test_quality_held_out(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(1200):
        words = prose(rng, rng.randrange(20, 200), 500).split(" ")
        kind = i % 3
        if kind == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "awful"])
        if kind == 1:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        docs.append((i, " ".join(words)))
        if i < 900:
            labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    df = frame(spark, docs, [(5000, None), (5001, ""), (None, "x")])
    told = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(df, told)
    have = {r.doc_id: r for r in out.collect()}
    assert len(have) == 1203
    for k in range(3):
        kept = np.mean([have[i].kept for i in range(900, 1200) if i % 3 == k])
        assert kept >= 0.97 if k == 2 else kept <= 0.05
    r = have[7]
    assert r.expected_grade == pytest.approx(r.p_ge_1 + r.p_ge_2) and r.p_ge_1 >= r.p_ge_2
    few = quality.train(df, told, entries=3000)
    assert np.count_nonzero(few.weights) and (few.weights != quality.train(df, told).weights).any()
    copies = frame(spark, [*docs, *[docs[5]] * 40], [(5, "other words")])
    assert (quality.train(copies, told).weights == quality.train(copies.repartition(7), told).weights).all()
    chosen = quality.select_documents(df, told)
    assert chosen.columns == df.columns
    assert {x.doc_id for x in chosen.collect()} == {i for i, x in have.items() if x.kept}
    assert quality.select_documents(df, told.where("false")).count() == 1203
    assert quality.classify(frame(spark, []), told).count() == 0


# ---------------------------------------------------------------- 8 substrings


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_substring_dedup(spark, rows, batches):
    have = got(substring_dedup.removal_report(frame(spark, rows, [(None, rows[20][1])]), batches), "n_words", "n_removed", "kept_sha256")
    assert have.pop(None)[1] == 0
    assert have == brute.repeated_words(rows)


def test_index_compacts_and_stays_whole(spark, rows):
    df = frame(spark, rows)
    index = substring_dedup.FingerprintIndex(df, fan_in=2)
    found = None
    for lo in range(0, 70, 10):
        part = index.ingest(df.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 10))).unionByName(index.verify())
        found = part if found is None else found.unionByName(part)
        assert index.runs <= 2
    assert index.runs >= 1 and spark.table(index.name).count() > 0
    plan = spark.table(index.name).groupBy("bucket").applyInArrow(lambda t: t, substring_dedup.RUN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs are read where they are
    spans = {}
    for r in found.collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.n))
    index.close()
    for i, (n, removed, _) in brute.repeated_words(rows).items():
        s = np.array(spans.get(i, []), np.int64).reshape(-1, 2)
        from tessella.llm.winnow import covered_symbols

        assert covered_symbols(s[:, 0], s[:, 1], 13, n).sum() == removed
    assert substring_dedup.removal_report(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 9 mixing


def test_mixing(spark, rows):
    df = frame(spark, rows, [(None, "no id here"), (11, rows[11][1])])
    full = [(r.doc_id, r.text, r.source) for r in df.collect()]
    want = sorted(((i is None, i or 0, *v) for (i, _, _), v in zip(full, brute.mix(full))))
    have = sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.source_size, r.target, r.taken) for r in mixing.mix_sizes(df).collect())
    assert [h[:4] + h[5:] for h in have] == [w[:4] + w[5:] for w in want]
    assert [h[4] for h in have] == pytest.approx([w[4] for w in want])
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    assert sum(len(brute.WORD.findall(r.text or "")) for r in out.collect()) == sum(w[5] for w in want)
    assert mixing.mix_documents(frame(spark, [])).count() == 0 and mixing.mix_sizes(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- 10 urls


@pytest.mark.parametrize("per_sweep", [500_000, 3])
def test_url_filter(spark, per_sweep):
    rng = random.Random(6)
    labels = ["a", "b", "net", "example"]
    urls = [None, "", "nothing", "://", "http://", "HTTP://A.Net/x?y#z", "http://a.net#/en", "x://net", "http://.net/"]
    urls += ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/", "/en/", "/en/x", "/de", "?q=/en/"]) for _ in range(300)]
    rules = [(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(["", "/", "/en/", "/de"]), rng.choice(["allow", "block"])) for _ in range(25)] + [("", "/en/x", "block")]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, k string")
    out = url_filters.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), per_sweep=per_sweep)
    have = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert have == {i: brute.judge_url(u, rules) for i, u in enumerate(urls)}
    none = url_filters.url_filter(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"}


# ---------------------------------------------------------------- hashes


def thue_morse(n, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_texts_whose_polynomial_hashes_agree_are_told_apart(spark):
    """Thue-Morse texts and their complements have equal polynomial hashes modulo 2^64 for every base."""
    one, two = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    rng = random.Random(5)
    rest = prose(rng, 30).split(" ")
    docs = [(1, " ".join([*rest[:12], one, *rest[12:]])), (2, " ".join([*rest[:12], two, "other", *prose(rng, 20).split(" ")]))]
    docs += [(3, one), (4, two), (5, thue_morse(2048, "x ", "y ")), (6, thue_morse(2048, "y ", "x "))]
    docs += [(7, f"{one} a b c d e f"), (8, f"{two} a b c d e f"), (9, "q" * 5000), (10, "q" * 4999 + "r")]
    df = frame(spark, docs)
    assert got(minhash.near_duplicates(df), "n_shingles", "component_id", "kept") == brute.near_duplicates(docs)
    assert got(substring_dedup.removal_report(df), "n_words", "n_removed", "kept_sha256") == brute.repeated_words(docs)
    assert got(suffix_dedup.removal_report(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix_report(docs)


def test_equal_spans_and_only_they_hash_alike():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 60_000).astype(np.uint8)
    start = rng.integers(0, 50_000, 20_000)
    size = np.r_[rng.integers(0, 40, 19_900), rng.integers(4000, 4200, 100)]
    h = core.span_hash(data, start, start + size)
    seen = {}
    for a, n, v in zip(start.tolist(), size.tolist(), h.tolist()):
        assert seen.setdefault(v, data[a : a + n].tobytes()) == data[a : a + n].tobytes()
    assert len(seen) == len(set(seen.values()))


# ---------------------------------------------------------------- quality: likelihood


def test_ordinal_step_follows_the_gradient_of_the_likelihood():
    """The fit raises the plain cumulative-link likelihood, and its end is near a point where its slope is 0."""
    rng = np.random.default_rng(5)
    cols = rng.integers(0, 12, (400, 3)).astype(np.uint32)
    truth = np.linspace(-3, 3, 12)
    grades = np.digitize(truth[cols].sum(1) + rng.logistic(size=400), [-1.5, 1.0])
    at = np.arange(0, 1201, 3)

    def likelihood(score, thresholds):
        tails = np.c_[np.ones(len(score)), 1 / (1 + np.exp(thresholds[None, :] - score[:, None])), np.zeros(len(score))]
        k = np.arange(len(score))
        return float(np.log(np.maximum(tails[k, grades] - tails[k, grades + 1], 1e-12)).mean())

    model = quality.fit_ordinal(at, cols.ravel(), np.ones(1200, np.float32), grades, epochs=40)
    score = model.weights[cols].sum(1).astype(float)
    share = np.array([(grades >= 1).mean(), (grades >= 2).mean()])
    best = likelihood(score, model.thresholds)
    assert best > likelihood(np.zeros(400), -np.log(share / (1 - share))) + 0.1
    assert model.thresholds[0] < model.thresholds[1]
    for k in range(2):  # no threshold can be moved for more than a little gain
        for step in (-0.2, 0.2):
            moved = model.thresholds.copy()
            moved[k] += step
            assert likelihood(score, moved) < best + 0.01
    assert np.corrcoef(model.weights[:12], truth)[0, 1] > 0.9
    flat = quality.fit_ordinal(at[:3], cols.ravel()[:6], np.ones(6, np.float32), np.array([2, 2]))
    assert flat.thresholds[0] < flat.thresholds[1] and np.isfinite(flat.weights).all()


def test_labels_with_ties_and_copies(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.grades_of(labels).collect()} == {1: 0, 2: 1, 3: 2}
