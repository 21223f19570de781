"""Centroid clustering by Delta Lloyd, in whole numbers.

Vectors become integers floor(SCALE * x) and are written once, shuffled by a row number, in a table
bucketed by it. Assignments (row, owner, distance to it) are a table of the same buckets, so that a
round joins the two where they are, without a shuffle. A round compares a vector with

* the centroids that changed since the last round, if its owner did not (its distance to it is known), or
* all centroids, if its owner changed place,

which gives the same owner as a comparison with all. Vectors whose owner is another now send their components,
negative to the old one and positive to the new one; these transfers are summed in the task, then by
centroid and component, and added to the global sums and counts, of which there are k times the dimension.
Centroids are the floors of sum by count in whole numbers; an empty one stays.

Cases: vectors that are null, of another length or hold null or non-finite components are not kept, nor
those with an integer beyond LIMIT in size (a squared distance would not fit in a long); a row with a null id is kept, its hash
is that of the seed alone; equal ids and vectors are rows of their own, at ties of the hash the smaller vector is first; with
fewer than k kept vectors there are as many centroids; no kept vector, or an empty table, gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import arrow_batches, materialize, partitions, release
from .lexicon import drop_bucketed, write_bucketed

CLUSTERS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
LIMIT = 1 << 27
#: Largest product of sums that doubles hold exactly.
EXACT = 1 << 51


def whole_vectors(table: DataFrame, ident: str, vector: str, dim: int = DIM) -> DataFrame:
    """id, v (integers) of the vectors that are kept."""
    x = F.col(vector).cast("array<double>")
    v = F.transform("_x", lambda c: F.floor(c * SCALE))
    fits = F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LIMIT / SCALE))
    kept = table.select(F.col(ident).cast("long").alias("id"), x.alias("_x")).where((F.size("_x") == dim) & fits)
    return kept.select("id", v.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash, in its order (k rows)."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(h, "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def squared_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to each of c."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if v.shape[1] * most * most * 4 < EXACT:
        x, y = v.astype(np.float64), c.astype(np.float64)
        d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
        return np.rint(d).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(1) for row in c], axis=1)


def assign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) of each vector now; owner -1 before the first round; ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    moved = np.zeros(len(centroids) + 1, bool)
    moved[changed] = True
    moved[-1] = True  # no owner yet
    again = moved[owner]
    if again.any():
        d = squared_distances(v[again], centroids)
        owner[again] = d.argmin(1)
        distance[again] = d.min(1)
    rest = np.flatnonzero(~again)
    if len(rest) and len(changed):
        d = squared_distances(v[rest], centroids[changed])
        at = d.argmin(1)
        best, number = d[np.arange(len(rest)), at], changed[at]
        better = (best < distance[rest]) | ((best == distance[rest]) & (number < owner[rest]))
        owner[rest[better]], distance[rest[better]] = number[better], best[better]
    return owner, distance


class Lloyd:
    """The state of a run: vectors, assignments, global sums and counts, centroids."""

    def __init__(self, vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED):
        self.spark, self.buckets = vectors.sparkSession, partitions(vectors.sparkSession)
        arrow_batches(self.spark)
        self.tables: list[str] = []
        numbered = materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "lloyd")
        self.vectors = self._bucketed(numbered.repartition(self.buckets, "row"))
        release(numbered)
        self.centroids = first_centroids(self.vectors.select("id", "v"), k, seed)
        self.dim = self.centroids.shape[1] if len(self.centroids) else 0
        self.sums = np.zeros((len(self.centroids), self.dim), object)  # whole numbers without a bound
        self.counts = np.zeros(len(self.centroids), object)
        self.changed = np.arange(len(self.centroids))
        self.owners: DataFrame | None = None

    def _bucketed(self, df: DataFrame) -> DataFrame:
        table, name = write_bucketed(df, "row", "lloyd")
        self.tables.append(name)
        return table

    def _drop(self, name: str) -> None:
        self.tables.remove(name)
        drop_bucketed(self.spark, name)

    def reassign(self) -> None:
        """One round of assignments; adds the transfers of moved vectors to the global sums."""
        held = self.spark.sparkContext.broadcast((self.centroids, self.changed))  # k vectors
        if self.owners is None:
            rows = self.vectors.select("row", "v", F.lit(-1).alias("was"), F.lit(0).cast("long").alias("d"))
        else:
            rows = self.vectors.select("row", "v").join(self.owners.select("row", F.col("owner").alias("was"), F.col("distance").alias("d")), "row")

        def run(batches):
            centroids, changed = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                was = batch.column("was").to_numpy()
                owner, distance = assign(_matrix(batch.column("v")), was.astype(np.int64), batch.column("d").to_numpy(), centroids, changed)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("was"), pa.array(owner, pa.int32()), pa.array(distance)], ["row", "was", "owner", "distance"])

        old = self.tables[1:]
        self.owners = self._bucketed(rows.mapInArrow(run, "row long, was int, owner int, distance long"))
        held.destroy()
        for name in old:
            self._drop(name)
        self._transfer()

    def _transfer(self) -> None:
        """Add the components of vectors that moved, signed, to the sums of the centroids they left and reached."""
        k, dim = len(self.centroids), self.dim
        moved = self.vectors.join(self.owners.where("owner <> was").select("row", "was", "owner"), "row").select("v", "was", "owner")

        def run(batches):
            sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _matrix(batch.column("v"))
                for sign, column in ((1, "owner"), (-1, "was")):
                    at = batch.column(column).to_numpy()
                    some = at >= 0
                    np.add.at(sums, at[some], sign * v[some])
                    np.add.at(counts, at[some], sign)
            c, j = np.nonzero(sums)
            told = np.r_[sums[c, j], counts]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[c, np.arange(k)], pa.int32()), pa.array(np.r_[j, np.full(k, -1)], pa.int32()), pa.array(told)], ["c", "j", "n"])

        # at most k * (dim + 1) rows come back
        for c, j, n in moved.mapInArrow(run, "c int, j int, n long").groupBy("c", "j").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            if j < 0:
                self.counts[c] += int(n)
            else:
                self.sums[c, j] += int(n)

    def recentre(self) -> None:
        """Centroids to the floors of their means; `changed` are those that moved."""
        new = self.centroids.copy()
        for c, n in enumerate(self.counts):
            if n:
                new[c] = [int(s) // int(n) for s in self.sums[c]]
        self.changed = np.flatnonzero((new != self.centroids).any(1))
        self.centroids = new

    def close(self) -> None:
        for name in list(self.tables):
            self._drop(name)


def lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Lloyd:
    """Clusters of whole vectors (id, v): `rounds` times assign and recentre, then a last assignment."""
    state = Lloyd(vectors, k, seed)
    if len(state.centroids):
        for _ in range(rounds):
            state.reassign()
            state.recentre()
        state.reassign()
    return state


def cluster_vectors(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """ident, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = table.sparkSession
    schema = f"{ident} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    state = lloyd(whole_vectors(table, ident, vector, dim), k, rounds, seed)
    if not len(state.centroids):
        state.close()
        return spark.createDataFrame([], schema)
    per = {r.owner: int(r.s) for r in state.owners.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    total = sum(per.values())
    facts = [(c, per.get(c, 0), total, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(state.centroids)]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = state.vectors.select("row", "id").join(state.owners.select("row", F.col("owner").alias("cluster"), "distance"), "row")
    return rows.join(F.broadcast(told), "cluster").select(F.col("id").alias(ident), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
