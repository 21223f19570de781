"""Embedding near-dedup by spherical-cap filters.

Filter directions are structured random product codes: after a random rotation a vector is cut into
blocks, each block has its own random unit codewords, and a direction is one codeword of each
block. A vector belongs to the filter of every direction with which its inner product exceeds a
height; these are found by list decoding, block by block, keeping only prefixes that can still reach
it. Vectors are joined on filters and every pair that meets is verified by cosine in doubles.

The height is chosen from the number of vectors so that a filter holds about PER_FILTER of them (lower
if a pair at the threshold would share too few), and the directions of a code so that such a pair shares
one filter of it on average, or fewer where that saves blocks; both from the exact measure of caps on the sphere. Filters of one code are
not independent, codes are: for any pair at the threshold the chance to share no filter of a code is one
number, which is measured on random pairs and codes, and codes are added until the chance to share none
at all is at most exp(-MEETINGS), at any number of vectors (less above the threshold).

Equal vectors are one class that counts with its multiplicity. A filter with more than BLOCK vectors
is compared as pairs of blocks. Pairs never leave a task: per vector there come out the number of its
links that this filter is the first to find and the smallest vector it is connected to here.

Cases: a vector that is null, zero, or holds a null or non-finite component links with nothing; so
does one whose id is null (its component is null, it is kept); vectors of different length never link.
Rows are the nodes, ids only name them: rows of equal id and vector count as copies, rows of equal id and
different vectors are two vectors, linked only by their cosine, and a component's id is the smallest id of
its rows. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import (
    arrow_batches,
    connected_components,
    join_sized,
    materialize,
    min_labels,
    partitions,
    release,
    split_blocks,
    whole_groups,
)

THRESHOLD, PER_FILTER, MEETINGS, BLOCK, SEED = 0.9, 256, 16.0, 2048, 20240229
#: Codewords of a block, and the least part of a filter's vectors that hold a given neighbour at the threshold.
WORDS, LEAST_SHARED = 256, 1 / 8
#: A cut into fewer blocks is taken with this many codes at most.
MOST_CODES = 128
#: Numbers from here on stand for classes whose least id is that of another class too; ids are below.
OTHER_IDS = 1 << 62
#: Random codes, and pairs for each, by which the chance to miss a pair is measured.
TRIALS, TRIAL_PAIRS = 32, 256


def _cap(dim: int, t: np.ndarray) -> np.ndarray:
    """P(u . x > t) of a random direction u and a unit vector x."""
    if dim == 1:
        return np.where(t < -1, 1.0, np.where(t < 1, 0.5, 0.0))
    angle = np.linspace(0, math.pi, 20001)
    density = np.sin(angle) ** (dim - 2)
    below = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return np.interp(np.arccos(np.clip(t, -1, 1)), angle, below / below[-1])


def _both_caps(dim: int, t: float, rho: float) -> float:
    """P(u . x > t, u . y > t) of a random direction u and unit vectors x, y with inner product rho."""
    if dim == 1:
        return float(_cap(dim, np.array(t)))
    angle = np.linspace(0, math.acos(t), 4001)[1:]
    share = np.diff(_cap(dim, np.cos(np.concatenate([[0], angle]))))
    mid = angle - angle[0] / 2
    return float((share * _cap(dim - 1, (t - rho * np.cos(mid)) / (math.sqrt(1 - rho * rho) * np.sin(mid)))).sum())


def random_pairs(rng, n: int, dim: int, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows x, y of random unit vectors with inner product rho."""
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = rho * x + math.sqrt(1 - rho * rho) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    return x, y / np.linalg.norm(y, axis=1, keepdims=True)


class ProductCode:
    """Filter directions for vectors of `dim` components, sized for n vectors."""

    def __init__(self, dim: int, n: int, threshold: float = THRESHOLD, per_filter: int = PER_FILTER, meetings: float = MEETINGS):
        rng = np.random.default_rng(SEED + dim)
        share = min(0.25, per_filter / max(n, 1))
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _cap(dim, np.array(mid)) > share else (lo, mid)
        self.height = 0.5 if dim == 1 else lo
        while (both := _both_caps(dim, self.height, threshold)) < LEAST_SHARED * _cap(dim, np.array(self.height)):
            self.height *= 0.98
        directions, sizes, options = 1 / both, [1], []
        while directions ** (1 / sizes[-1]) > WORDS and sizes[-1] < max(1, dim // 8):
            sizes.append(sizes[-1] + 1)
        for blocks in sizes:
            words = math.ceil(directions ** (1 / blocks))
            self._cut(dim, blocks, max(2, words if blocks == sizes[-1] else min(WORDS, words)))
            missed = np.array([self._missed(rng, dim, threshold) for _ in range(TRIALS)])
            above = missed.mean() + 4 * missed.std() / math.sqrt(TRIALS)  # the measured chance, with its own error
            codes = math.ceil(meetings / -math.log(min(max(above, 1 / (TRIALS * TRIAL_PAIRS)), 0.999)))
            if codes <= MOST_CODES or blocks == sizes[-1]:
                options.append((codes * self.words**blocks, codes, blocks, self.words))
        _, codes, blocks, words = min(options)  # the fewest filters of a vector
        self._cut(dim, blocks, words)
        self.codes = [(np.linalg.qr(rng.standard_normal((dim, dim)))[0], self._books(rng, dim)) for _ in range(codes)]

    def _cut(self, dim: int, blocks: int, words: int) -> None:
        self.parts, self.words = np.array_split(np.arange(dim), blocks), words

    def _books(self, rng, dim: int) -> list[np.ndarray]:
        books = []
        for part in self.parts:
            book = rng.standard_normal((self.words, len(part)))
            books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt(len(part) / dim))
        return books

    def _missed(self, rng, dim: int, rho: float) -> float:
        """The part of random pairs that share no filter of one random code."""
        books = self._books(rng, dim)
        keys = []
        for v in random_pairs(rng, TRIAL_PAIRS, dim, rho):
            row, code = self._decode(v, books, 0)
            keys.append(row * self.words ** len(self.parts) + code)
        met = np.intersect1d(*keys) // self.words ** len(self.parts)
        return 1 - len(np.unique(met)) / TRIAL_PAIRS

    def _decode(self, x: np.ndarray, books: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter of code n that a rotated unit vector exceeds."""
        dots = [x[:, p] @ b.T for p, b in zip(self.parts, books)]
        reach = np.zeros((len(dots) + 1, len(x)))
        for k in range(len(dots) - 1, -1, -1):
            reach[k] = reach[k + 1] + dots[k].max(1)
        row, code, total = np.arange(len(x)), np.full(len(x), n, np.int64), np.zeros(len(x))
        for k, d in enumerate(dots):
            t = total[:, None] + d[row]
            i, j = np.nonzero(t + reach[k + 1][row][:, None] > self.height)
            row, code, total = row[i], code[i] * self.words + j, t[i, j]
        return row, code

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a unit vector exceeds, sorted by row, then filter."""
        rows, filters = [], []
        for n, (rotation, books) in enumerate(self.codes):
            row, code = self._decode(unit @ rotation, books, n)
            rows.append(row)
            filters.append(code)
        row, code = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((code, row))
        return row[order], code[order]


def _vectors(column, kind: str) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(flat.to_pylist()), kind)


def _number(code: ProductCode) -> type:
    """The type that holds the number of any filter of a code."""
    return np.uint32 if len(code.codes) * code.words ** len(code.parts) < 1 << 32 else np.int64


def filter_rows(reps: DataFrame, codes: dict[int, ProductCode], kind: str) -> DataFrame:
    """rep, mult, dim, vec, fids (the vector's filters before this one), fid: a row for each filter that a vector exceeds."""
    held = reps.sparkSession.sparkContext.broadcast(codes)  # a few codewords for each dimension

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                vecs = part.column("embedding")
                size = np.diff(np.asarray(vecs.offsets))
                for dim in np.unique(size).tolist():
                    pick = np.flatnonzero(size == dim)
                    sub = part.take(pa.array(pick))
                    x = np.asarray(sub.column("embedding").flatten(), kind).reshape(len(pick), dim)
                    y = x.astype(np.float64)
                    y /= np.abs(y).max(1, keepdims=True)
                    row, fid = held.value[dim].decode(y / np.linalg.norm(y, axis=1, keepdims=True))
                    if not len(row):
                        continue
                    begin = np.searchsorted(row, row).tolist()
                    flat = fid.astype(_number(held.value[dim])).tobytes()
                    wide = len(flat) // len(fid)
                    lists = [flat[a * wide : k * wide] for k, a in enumerate(begin)]
                    blobs = [v.tobytes() for v in x]
                    yield pa.RecordBatch.from_arrays([
                        sub.column("rep").take(pa.array(row)), sub.column("mult").take(pa.array(row)), pa.array(np.full(len(row), dim, np.int32)),
                        pa.array([blobs[r] for r in row], pa.binary()), pa.array(lists, pa.binary()), pa.array(fid),
                    ], ["rep", "mult", "dim", "vec", "fids", "fid"])

    return reps.mapInArrow(run, "rep long, mult long, dim int, vec binary, fids binary, fid long")


def _compare(group: pa.Table, first_block: bool, kind: str, threshold: float, number: type):
    """Link counts by row (links that this filter is the first to find) and the smallest connected row."""
    n = group.num_rows
    block = group.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    x = _vectors(group.column("vec"), kind).astype(np.float64).reshape(n, -1)[order]
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mult, rep = group.column("mult").to_numpy()[order], group.column("rep").to_numpy()[order]
    sorted_block = block[order]
    split = n if first_block else int(np.searchsorted(sorted_block, sorted_block[-1]))
    links, pairs = np.zeros(n, np.int64), []
    right = np.arange(n) if first_block else np.arange(split, n)
    for lo in range(0, split, 512):
        hi = min(lo + 512, split)
        close = x[lo:hi] @ x[right].T >= threshold
        close &= rep[lo:hi, None] != rep[right][None, :]
        i, j = np.nonzero(close)
        if len(i):
            pairs.append((i + lo, right[j]))
    if pairs:
        # incidence of the rows in pairs with the earlier filters of several: two rows met before if their products are not 0
        live = np.unique(np.concatenate([v for p in pairs for v in p]))
        earlier = [np.frombuffer(b, number) for b in group.column("fids").take(pa.array(order[live])).to_pylist()]
        names, at, held = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
        at, of = at.ravel(), np.repeat(np.arange(len(live)), [len(v) for v in earlier])
        column, several = np.cumsum(held > 1) - 1, (held > 1)[at]
        seen = np.zeros((len(live), int((held > 1).sum())), np.float32)
        seen[of[several], column[at[several]]] = 1
        for i, j in pairs:
            i, j = np.searchsorted(live, i), np.searchsorted(live, j)
            lo, hi = int(i.min()), int(i.max()) + 1
            new = (seen[lo:hi] @ seen.T == 0)[i - lo, j]
            np.add.at(links, live[i[new]], mult[live[j[new]]])
            if not first_block:
                np.add.at(links, live[j[new]], mult[live[i[new]]])
    label = rep
    if pairs:
        by_id = np.argsort(rep, kind="stable")
        place = np.empty(n, np.int64)
        place[by_id] = np.arange(n)
        a, b = (place[np.concatenate([p[k] for p in pairs])] for k in (0, 1))
        label = rep[by_id[min_labels(n, a, b)[place]]]
    return rep, links, label


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id long, embedding array)."""
    arrow_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    if kind == "f8":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    fine = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("embedding", lambda v: v != 0)
    )
    valid = vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", "embedding")
    classes = materialize(valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult")), "cap")
    # a class goes by its least id; where several have the same, all but one get a number above all ids instead
    shared = classes.groupBy("least").count().where("count > 1").select("least")
    named = shared.limit(1).count() > 0
    if named:
        own = Window.partitionBy("least").orderBy(F.xxhash64("embedding"), "embedding")
        several = classes.join(shared, "least", "left_semi").withColumn("_n", F.row_number().over(own))
        number = F.lit(OTHER_IDS) + F.monotonically_increasing_id()
        several = several.withColumn("rep", F.when(F.col("_n") == 1, F.col("least")).otherwise(number)).drop("_n")
        classes = materialize(classes.join(shared, "least", "left_anti").withColumn("rep", F.col("least")).unionByName(several), "cap")
    else:
        classes = classes.withColumn("rep", F.col("least"))
    sizes = {r[0]: r[1] for r in classes.groupBy(F.size("embedding")).count().collect()}  # one row for each dimension
    codes = {d: ProductCode(d, n, threshold) for d, n in sizes.items()}
    numbers = {d: _number(c) for d, c in codes.items()}
    rows = materialize(filter_rows(classes.select("embedding", "mult", "rep").repartition(partitions(spark)), codes, kind), "cap")
    counts = rows.groupBy("dim", "fid").agg(F.count("*").alias("n")).where("n > 1")
    rows_met = split_blocks(join_sized(rows, materialize(counts, "cap"), ["dim", "fid"], "inner"), "n", "rep", BLOCK)
    keys = ["dim", "fid", "lo", "hi"]
    met = rows_met.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches):
        for table, at in whole_groups(batches, keys, 4000):
            out = []
            for a, b in zip(at, [*at[1:], table.num_rows]):
                group = table.slice(a, b - a)
                same = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
                if b - a > 1:
                    rep, links, label = _compare(group, same, kind, threshold, numbers[group.column("dim")[0].as_py()])
                    some = (links > 0) | (label != rep)
                    out.append((rep[some], links[some], label[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["rep", "links", "label"])

    found = materialize(met.mapInArrow(run, "rep long, links long, label long"), "cap")
    release(rows)
    comps = connected_components(found.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # components of classes that go by a number take their least id
    if named:
        other = classes.where(F.col("rep") >= OTHER_IDS).select("rep", "least")
        lower = comps.join(other, comps.node == other.rep).groupBy("component").agg(F.min("least").alias("_lower"))
        comps = join_sized(comps, materialize(lower, "cap"), "component", "left").select("node", F.least("component", "_lower").alias("component"))
    several = classes.where((F.col("mult") > 1) | (F.col("rep") != F.col("least"))).select(F.col("embedding").alias("_e"), F.col("rep").alias("_rep"), "least", "mult")
    several = materialize(several, "cap")
    out = vectors.select("vec_id", "embedding", F.coalesce(fine, F.lit(False)).alias("_fine"))
    hot = F.when(F.col("_fine"), F.col("embedding"))  # null joins with nothing
    out = join_sized(out.withColumn("_e", hot), several, "_e", "left")
    out = out.select("vec_id", "_fine", F.coalesce("_rep", "vec_id").alias("rep"), F.coalesce("least", "vec_id").alias("least"), F.coalesce("mult", F.lit(1)).alias("mult"))
    out = out.join(links, "rep", "left").join(comps, out.rep == comps.node, "left")
    component = F.when(F.col("_fine"), F.coalesce("component", "least")).otherwise(F.col("vec_id"))
    n_links = F.when(F.col("_fine"), F.col("mult") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    return out.select(
        "vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
