"""Best-fit packing of token pieces into sequences.

Documents are tokenised and cut into pieces of at most `size` tokens. The number of pieces of each
length is a histogram of at most `size` entries, however large the corpus, and the packing of a
histogram is planned on the driver:

* The configuration linear program (fewest sequences so that each length is covered; a column is a
  multiset of lengths that fits) is solved by multiplicative weights. Each length has a weight; the
  knapsack dynamic program over the capacity sums, over all configurations, the products of their
  weights (the soft form of the dearest configuration, which leaves no configuration out), and gives
  how often a length is used per sequence. Weights of lengths used less than their share of the
  pieces rise by that ratio, until all are covered within GAP of the bound from the dual prices, or no round brings more
  (few or nearly equal lengths, whose dearest configurations the soft form reaches only in the limit).
* Rounding: configurations are drawn from the priced dynamic program (DRAWS at most a round), each a
  whole number of times, and taken as far as their pieces last; every round takes about half of what
  is left and prices the rest again, so the rounds grow with the logarithm of the corpus.
* The last pieces (usually at most twice as many as there are lengths and a sixteenth of all; more where no drawn
  configuration fits what is left) go by best fit decreasing over their histogram. So do all pieces if that
  needs fewer sequences, as for some small or narrow histograms: the plan never needs more than best fit decreasing.

Pieces then get a rank among those of their length, in two levels (salted counts, then the rank
within length and salt), and the rank says which sequence and offset the plan gives to the piece.

Cases: null text is empty and has the single separator id; an empty table gives no pieces; equal
rows, and rows of equal or null id, are packed as often as they stand there; a text of any length, with white space or
without, is encoded whole and cut into pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import arrow_batches, materialize

SIZE, END_ID = 2048, 0
#: Pieces of a length that are ranked together at least, and groups of them in all beside one for each length.
PER_SALT, SALTS = 1000, 50_000
#: Distance from the dual bound at which pricing ends, rounds of it at most; configurations drawn in a round.
GAP, ROUNDS, DRAWS = 0.005, 60, 2000
#: Logarithm of the weight that a token has at first (the higher, the less room configurations leave); part of the
#: way to the wanted usage that a round goes.
TOKEN, STEP = 0.3, 0.6
#: Largest change of the logarithm of a weight before STEP; how often all weights are doubled at most.
MOST_STEP, HARDER = 8.0, 4


@cache
def _tokenizers(path: str):
    import base64
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    special = [t["content"] for t in json.loads(exact.to_str())["added_tokens"]]
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return exact, None, special
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return exact, fast, special


def encode(path: str, text: str) -> list[int]:
    """Ids of the tokenizer file at path, without special tokens added.

    The rank file of the same vocabulary beside it gives the same ids four times as fast; a text
    that holds the string of a special token goes to the tokenizer itself.
    """
    exact, fast, special = _tokenizers(path)
    if fast is None or any(s in text for s in special):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(path, text.as_py() or ""), END_ID], "<u4")
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, fields)], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the plan


def dearest(prices: np.ndarray, size: int) -> float:
    """Price of the dearest multiset of lengths that fits in size; prices[l] is that of length l."""
    best, backwards = np.zeros(size + 1), prices[::-1]  # backwards[size - l] = prices[l]
    for c in range(1, size + 1):
        best[c] = max(best[c - 1], (best[:c] + backwards[size - c : size]).max())
    return float(best[size])


class _Priced:
    """All configurations of lengths, each weighing the product of exp(weights) of its lengths."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, size: int):
        # a factor exp(-tilt) for each token, room included, changes no proportion and keeps sums near 1
        lo, hi = 0.0, 64.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.logaddexp.reduce(weights - mid * lengths) > 0 else (lo, mid)
        self.lengths, self.size = lengths, size
        self.w = np.zeros(size + 1)
        self.w[lengths] = np.exp(weights - hi * lengths)
        backwards = self.w[::-1].copy()
        exact = np.zeros(size + 1)  # sum over the configurations of exactly c tokens
        exact[0] = 1.0
        for c in range(1, size + 1):
            exact[c] = exact[:c] @ backwards[size - c : size]
        self.exact, self.upto, total = exact, np.empty(size + 1), 0.0  # of at most c tokens
        for c in range(size + 1):
            total = total * np.exp(-hi) + exact[c]
            self.upto[c] = total

    def holds(self) -> bool:
        """Whether the sums are still numbers: weights so high that no room is left over can go beyond them."""
        return bool(np.isfinite(self.upto).all() and np.isfinite(self.w).all() and self.upto[self.size] > 1e-250)

    def usage(self) -> np.ndarray:
        """How often a sequence holds each of the lengths."""
        both = np.convolve(self.exact, self.upto)[: self.size + 1]
        used = self.w[self.lengths] * both[self.size - self.lengths] / self.upto[self.size]
        return np.maximum(used, 1e-290)

    def draw(self, rng, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(configuration, length) of n configurations drawn by their weight."""
        ways = np.zeros((self.size + 1, len(self.lengths)))  # by room and length; the one large table of the plan
        for k, length in enumerate(self.lengths.tolist()):
            ways[length:, k] = self.w[length] * self.upto[: self.size + 1 - length]
        np.cumsum(ways, axis=1, out=ways)
        room, live, rows = np.full(n, self.size), np.arange(n), []
        while len(live):
            u = rng.random(len(live)) * self.upto[room[live]]
            goes_on = u < ways[room[live], -1]
            live, u = live[goes_on], u[goes_on]
            lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.lengths) - 1)
            while (lo < hi).any():
                mid = (lo + hi) // 2
                below = ways[room[live], mid] <= u
                lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
            rows.append((live, self.lengths[lo]))
            room[live] -= self.lengths[lo]
        config, length = (np.concatenate(x) for x in zip(*rows))
        return config, length


def solve_program(need: np.ndarray, size: int = SIZE, rounds: int = ROUNDS, gap: float = GAP) -> tuple[np.ndarray, float, float]:
    """(weights of the lengths, sequences of the fractional plan, lower bound from the dual prices).

    The weights kept are those of the least value seen. A round whose value rises halves the step; where rounds bring no
    more, all weights are doubled (the soft form then comes nearer to the dearest configuration), HARDER times at most.
    """
    lengths = np.flatnonzero(need)
    n = need[lengths].astype(np.float64)
    weights, bound, value = np.log(n / n.sum()) + TOKEN * lengths, float((n * lengths).sum() / size), np.inf
    best, step, still, harder, last = weights.copy(), STEP, 0, 0, np.inf
    for k in range(rounds * (HARDER + 1)):
        priced = _Priced(lengths, weights, size)
        if not priced.holds():
            break
        used = priced.usage()
        now = float((n / used).max())  # that many sequences cover every length
        if now < value * (1 - 1e-4):
            still = 0
        else:
            still += 1
        if now < value:
            value, best = now, weights.copy()
        step = max(step / 2, STEP / 64) if now > last else min(step * 1.1, STEP)
        last = now
        if k % 4 == 0:
            prices = np.zeros(size + 1)
            prices[lengths] = np.maximum(weights, 0)
            bound = max(bound, float((prices[lengths] * n).sum() / dearest(prices, size)) if prices.any() else 0.0)
        if value <= bound * (1 + gap):
            break
        if still > 12 or (k + 1) % rounds == 0:
            if harder == HARDER:
                break
            weights, harder, still, step, last = best * 2, harder + 1, 0, STEP, np.inf
            continue
        weights = weights + step * np.clip(np.log(n / used / bound) - GAP / 2, -MOST_STEP, MOST_STEP)  # towards a plan that is as good as the bound
    return best, value, bound


def plan_packing(histogram: dict[int, int], size: int = SIZE):
    """Configurations [(lengths, counts, times)] that place exactly the pieces of the histogram, a lower
    bound on the number of sequences from the program's dual, and how many pieces the program placed."""
    need = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        need[length] = n
    plan: list[tuple[np.ndarray, np.ndarray, int]] = []
    all_need = need.copy()
    if need[size]:
        plan.append((np.array([size]), np.array([1]), int(need[size])))
    whole, total = int(need[size]), int(need.sum())
    need[size] = 0
    if not need.any():
        return plan, whole, total
    weights = np.zeros(size + 1)
    weights[np.flatnonzero(need)], _, bound = solve_program(need, size)
    left, most, strict, rng = need.copy(), 2 * np.count_nonzero(need), True, np.random.default_rng(7)
    while left.sum() > min(most, max(total // 16, 64)):
        lengths = np.flatnonzero(left)
        for _ in range(3):  # prices of what is left
            priced = _Priced(lengths, weights[lengths], size)
            if not priced.holds():
                break
            used = priced.usage()
            about = float((left[lengths] * lengths).sum() / (used * lengths).sum())
            weights[lengths] += STEP * np.clip(np.log(left[lengths] / (used * about)), -MOST_STEP, MOST_STEP)
        priced = _Priced(lengths, weights[lengths], size)
        if not priced.holds():
            break
        n = int(min(max(about / 2, 16), DRAWS))
        times = max(1, int(about / 2 / n))
        # where the tokens are what binds, only configurations that leave no room are taken
        full = strict and about <= (left * np.arange(size + 1)).sum() / size * 1.02
        config, length = priced.draw(rng, 3 * n if full else n)
        if full:
            room = size - np.bincount(config, length, minlength=3 * n)
            keep = (np.cumsum(room == 0) <= n) & (room == 0)
            config, length = config[keep[config]], length[keep[config]]
        key, counts = np.unique(config * (size + 1) + length, return_counts=True)
        config, length = key // (size + 1), key % (size + 1)
        # a configuration is taken if its pieces are there after those before it
        order = np.lexsort((config, length))
        wanted = counts[order] * times
        sums = np.cumsum(wanted)
        first = np.r_[True, np.diff(length[order]) != 0][: len(order)]
        sums -= np.maximum.accumulate(np.where(first, sums - wanted, 0))
        lacks = np.unique(config[order][sums > left[length[order]]])
        some = ~np.isin(config, lacks)
        config, length, counts = config[some], length[some], counts[some]
        if not len(config):
            if not full:
                break
            strict = False  # the room of what is left can't be filled any more
            continue
        left -= np.bincount(length, counts * times, minlength=size + 1).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, np.diff(config) != 0, True])
        same: dict[tuple, int] = {}
        for a, b in zip(edge, edge[1:]):
            key = (tuple(length[a:b][::-1].tolist()), tuple(counts[a:b][::-1].tolist()))
            same[key] = same.get(key, 0) + times
        plan += [(np.array(ls), np.array(cs), k) for (ls, cs), k in same.items()]
    made, simple = plan + best_fit(left, size), best_fit(all_need, size)
    if sum(t for _, _, t in simple) < sum(t for _, _, t in made):  # the program has not come near enough
        return simple, whole + int(np.ceil(bound - 1e-6)), whole
    return made, whole + int(np.ceil(bound - 1e-6)), total - int(left.sum())


def best_fit(left: np.ndarray, size: int):
    """Best fit decreasing of a histogram: each piece, longest first, into the fullest sequence that has room. Equal
    sequences are one group and equal pieces go together, so the time does not depend on how many there are: a sequence
    that is the fullest stays it while the next equal piece fits."""
    groups: dict[int, list[tuple[tuple, int]]] = {}  # open sequences by free room: (contents, how many)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = min((r for r in groups if r >= length), default=size)
            held, many = groups[at].pop() if at in groups else ((), n)  # new ones as needed
            fresh = held == ()
            each = at // length
            full, rest = divmod(n, each)
            done = min(full, many)
            placed = [(done, each)] if done else []
            if done < many and rest and done == full:
                placed.append((1, rest))
            if not fresh and (over := many - sum(k for k, _ in placed)):
                groups[at].append((held, over))
            for k, count in placed:
                groups.setdefault(at - length * count, []).append(((*held, (length, count)), k))
                n -= k * count
            if at in groups and not groups[at]:
                del groups[at]
    return [(np.array([a for a, _ in held]), np.array([b for _, b in held]), k) for same in groups.values() for held, k in same]


class _Places:
    """Sequence and offset of the r-th piece of a length."""

    def __init__(self, plan):
        self.by: dict[int, list] = {}
        base = 0
        for lengths, counts, times in plan:
            offset = 0
            for length, count in zip(lengths.tolist(), counts.tolist()):
                self.by.setdefault(length, []).append((count * times, base, count, offset))
                offset += length * count
            base += times
        self.sequences = base
        self.table = {}
        for length, parts in self.by.items():
            a = np.array(parts, np.int64)
            self.table[length] = (np.cumsum(a[:, 0]) - a[:, 0], a[:, 1], a[:, 2], a[:, 3])

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(order) else []
        for a, b in zip(at, [*at[1:], len(order)]):
            sel = order[a:b]
            size = int(length[sel[0]])
            start, base, count, offset = self.table[size]
            k = np.searchsorted(start, rank[sel], "right") - 1
            inner = rank[sel] - start[k]
            seq[sel] = base[k] + inner // count[k]
            off[sel] = offset[k] + inner % count[k] * size
        return seq, off


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (a written table with a length column) with sequence_id and offset."""
    spark = pieces.sparkSession
    names = pieces.columns
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    per_salt = max(PER_SALT, sum(histogram.values()) // SALTS)
    # a length that very many pieces have is ranked in many groups
    salts = spark.createDataFrame([(k, -(-n // per_salt)) for k, n in sorted(histogram.items())], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").select(*names, F.pmod(F.xxhash64(*names), F.col("_salts")).cast("int").alias("_salt"))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()  # at most size + SALTS rows
    base: dict[int, np.ndarray] = {k: np.zeros(-(-n // per_salt), np.int64) for k, n in histogram.items()}
    for length, salt, n in counts:
        base[length][salt] = n
    base = {k: np.cumsum(v) - v for k, v in base.items()}
    plan, _, _ = plan_packing(histogram, size)
    places = spark.sparkContext.broadcast((_Places(plan), base))  # grows with the rounds of the plan only
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*names)) - 1)
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches):
        plan, base = places.value
        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_rank"))
            at = np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                at[length == k] = base[k][salt[length == k]]
            seq, off = plan.of(length, at + rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    arrow_batches(docs.sparkSession)
    return pack(materialize(token_pieces(docs, path, size), "pack"), size)
