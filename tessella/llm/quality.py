"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(s - threshold_k) with one score s for a text and ordered thresholds. s is a
sum of weights shared by all grades: one per hashed lower-case word (present or not), one per hashed
word shape (square root of the shape's share of the words), one for repetition of the word before,
and one that every text has. From the tail probabilities come the expected grade and the selection.

Grades here: 0 toxic, 1 poor, 2 good. The model is fitted on the driver on at most TRAIN_ROWS
labelled rows (those of smallest hash) with at most TRAIN_ENTRIES features together (texts of smallest
hash first), both documented bounds, and the weights, a table of fixed size, are broadcast. Scoring reads every text whole.

Cases: null text counts as empty and has score 0; labels without document, or with null in any
column, are not used; a document with several labels has the smallest grade, and of rows that share an id
the one of smallest text hash is fitted; without labels nothing
is rejected; equal rows score equally; further columns are kept by select_documents().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .core import arrow_batches, materialize, mix, release, text_blocks

BUCKETS, TRAIN_ROWS, TRAIN_ENTRIES, GRADES = 1 << 20, 20_000, 20_000_000, 3
EPOCHS, STEP, RIDGE = 16, 0.35, 5e-4
#: Buckets from here on are for shapes; a word that is in more than this share of the fitted texts has no weight.
WORDS, COMMON = BUCKETS - (1 << 14), 0.5
_SHAPE_SCALE, _ALWAYS = 15.0, 10.0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = np.zeros(256, np.uint64)  # bit of each byte in a word's shape
_CLASS[128:] = 1
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 4
for _i, _c in enumerate("!*#$%&|.,;:?-_'\"()[]{}<>/\\=+@~^`"):
    _CLASS[ord(_c)] = 1 << (3 + _i)


def features(data: np.ndarray, offs: np.ndarray):
    """(row, bucket, value) of a block, sorted by row."""
    n = len(offs) - 1
    s, e, row, plain = core.words(data, offs)
    # lower-case runs of letters and digits
    letters = np.where(_LETTER[data], core._LOWER[data], np.uint8(0x20)) if len(data) else data
    _, _, wrow, h = core.words(letters, offs)
    keys = np.unique((wrow.astype(np.uint64) << np.uint64(20)) | (h % np.uint64(WORDS)))
    r = (keys >> np.uint64(20)).astype(np.int64)
    many = np.sqrt(np.bincount(r, minlength=n))  # the sum over a very long text's words grows as their root
    rows, cols = [np.arange(n), r], [np.full(n, WORDS), (keys & np.uint64(BUCKETS - 1)).astype(np.int64)]
    vals = [np.full(n, _ALWAYS, np.float32), np.minimum(1.0, 20 / np.maximum(many[r], 1)).astype(np.float32)]
    if len(s):
        total = np.bincount(row, minlength=n)
        bits = np.bitwise_or.reduceat(_CLASS[data], s)  # white space has no bit
        first_upper = (_CLASS[data[s]] == 2).astype(np.uint64)
        spread = np.uint64(BUCKETS - WORDS - 2)
        shape = mix(bits * np.uint64(2) + first_upper + np.uint64(0xABCDEF)) % spread + np.uint64(WORDS + 2)
        again = np.r_[False, (plain[1:] == plain[:-1]) & (row[1:] == row[:-1])]
        shape = np.concatenate([shape, np.full(int(again.sum()), WORDS + 1, np.uint64)])
        srow = np.concatenate([row, row[again]])
        key, count = np.unique((srow.astype(np.uint64) << np.uint64(20)) | shape, return_counts=True)
        r = (key >> np.uint64(20)).astype(np.int64)
        rows.append(r)
        cols.append((key & np.uint64(BUCKETS - 1)).astype(np.int64))
        vals.append((_SHAPE_SCALE * np.sqrt(count / total[r])).astype(np.float32))
    r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    order = np.argsort(r, kind="stable")
    return r[order], c[order], v[order]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit_ordinal(at: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, epochs: int = EPOCHS) -> OrdinalModel:
    """Fit by mini-batch AdaGrad on the cumulative-link likelihood; row i has entries at[i]:at[i+1]."""
    w, sq = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    n = len(grades)
    if not n:
        return OrdinalModel(w.astype(np.float32), np.full(GRADES - 1, -20.0))
    in_texts = sum(np.bincount(cols[i : i + 500_000], minlength=BUCKETS) for i in range(0, len(cols), 500_000))
    in_texts[WORDS:] = 0
    common = in_texts > COMMON * n
    share = np.array([np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, GRADES)])
    first = -np.log(share[0] / (1 - share[0]))
    gaps = np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 1e-2))  # thresholds = first + sums of exp(gaps)
    head, head_sq = np.r_[first, gaps], np.full(GRADES - 1, 1e-2)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            pick = order[lo : lo + 64]
            size = at[pick + 1] - at[pick]
            entry = np.repeat(at[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            local = np.repeat(np.arange(len(pick)), size)
            c, v = cols[entry].astype(np.int64), vals[entry]
            v = np.where(common[c], np.float32(0), v)
            score = np.bincount(local, w[c] * v, minlength=len(pick))
            theta = np.r_[head[0], head[0] + np.cumsum(np.exp(head[1:]))]
            tail = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -40, 40)))
            up = np.c_[np.ones(len(pick)), tail, np.zeros(len(pick))]
            y, rows = grades[pick], np.arange(len(pick))
            p = np.maximum(up[rows, y] - up[rows, y + 1], 1e-9)
            slope = np.c_[np.zeros(len(pick)), tail * (1 - tail), np.zeros(len(pick))]
            ds = (slope[rows, y] - slope[rows, y + 1]) / p  # gradient of the log likelihood
            dtheta = np.zeros((len(pick), GRADES + 1))
            dtheta[rows, y] -= slope[rows, y] / p
            dtheta[rows, y + 1] += slope[rows, y + 1] / p
            dtheta = dtheta[:, 1:GRADES].sum(0) / len(pick)
            c, v, local = c[v > 0], v[v > 0], local[v > 0]
            used, place = np.unique(c, return_inverse=True)
            g = np.bincount(place, ds[local] * v, minlength=len(used)) - RIDGE * len(pick) * w[used]
            sq[used] += g * g
            w[used] += STEP * g / np.sqrt(sq[used] + 1.0)
            dh = np.r_[dtheta.sum(), [dtheta[k:].sum() * np.exp(head[k]) for k in range(1, GRADES - 1)]]
            head_sq += dh * dh
            head += 0.1 * dh / np.sqrt(head_sq)
    return OrdinalModel(w.astype(np.float32), np.r_[head[0], head[0] + np.cumsum(np.exp(head[1:]))])


def grades_of(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    labels = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return labels.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, entries: int = TRAIN_ENTRIES) -> OrdinalModel:
    """Fit on at most `rows` labelled documents of at most `entries` features together."""
    arrow_batches(docs.sparkSession)
    sample = grades_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    told = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("key", F.xxhash64("text"))
    told = told.groupBy("doc_id", "grade").agg(F.min_by("text", "key").alias("text"), F.min("key").alias("key")).select("text", "grade", "key")

    def run(batches):
        for batch in batches:
            for i, j, data, offs in text_blocks(batch.column(0)):
                r, c, v = features(data, offs)
                at = np.searchsorted(r, np.arange(j - i + 1))
                cut = list(zip(at, at[1:]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(2)[i:j], batch.column(1)[i:j].cast(pa.int32()), core.blobs([c[a:b].astype(np.uint32) for a, b in cut]),
                    core.blobs([v[a:b] for a, b in cut]),
                ], ["key", "grade", "cols", "vals"])

    found = materialize(told.mapInArrow(run, "key long, grade int, cols binary, vals binary"), "fit")
    # positions in an order that tasks have no part in: at most `rows` rows, and as many as `entries` allows (one at least)
    sizes = sorted(map(tuple, found.select("key", "grade", (F.length("cols") / 4).cast("long")).collect()))
    at = np.r_[0, np.cumsum([n for _, _, n in sizes], dtype=np.int64)]
    kept = min(len(sizes), max(1, int(np.searchsorted(at, entries, "right")) - 1))
    at, places = at[: kept + 1], {}
    for i, told_by in enumerate(sizes[:kept]):
        places.setdefault(told_by, []).append(i)
    grades = np.array([g for _, g, _ in sizes[:kept]], np.int64)
    cols, vals = np.zeros(at[-1], np.uint32), np.zeros(at[-1], np.float32)
    some = found.where(F.col("key") <= sizes[kept - 1][0]) if kept else found
    for key, grade, c, v in some.coalesce(8).toLocalIterator():  # an eighth at a time, straight to its place
        free = places.get((key, grade, len(c) // 4))
        if free:
            i = free.pop()
            cols[at[i] : at[i + 1]], vals[at[i] : at[i + 1]] = np.frombuffer(c, np.uint32), np.frombuffer(v, np.float32)
    release(found)
    return fit_ordinal(at, cols, vals, grades)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade, p_ge_1, p_ge_2 of every row."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # fixed size

    def run(batches):
        model = OrdinalModel(*held.value)
        for batch in batches:
            for i, j, data, offs in text_blocks(batch.column(1)):
                r, c, v = features(data, offs)
                tail = model.tails(np.bincount(r, model.weights[c] * v, minlength=j - i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(tail.sum(1)), pa.array(tail[:, 0]), pa.array(tail[:, 1])],
                    ["doc_id", "expected_grade", "p_ge_1", "p_ge_2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, p_ge_1 double, p_ge_2 double")


def classify(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """score() and kept: the tail probability of the best grade is at least `at_least`."""
    return score(docs, train(docs, labels)).withColumn("kept", F.col("p_ge_2") >= at_least)


def select_documents(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns, in one pass and without a shuffle."""
    model = train(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    schema = docs.schema

    def run(batches):
        model = OrdinalModel(*held.value)
        for batch in batches:
            for i, j, data, offs in text_blocks(batch.column(batch.schema.names.index("text"))):
                r, c, v = features(data, offs)
                tail = model.tails(np.bincount(r, model.weights[c] * v, minlength=j - i))
                yield batch.slice(i, j - i).filter(pa.array(tail[:, -1] >= at_least))

    return docs.mapInArrow(run, schema)
