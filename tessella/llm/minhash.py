"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct 5-word shingles (A-Z lower-cased). Documents with equal sets are
one class, represented by the smallest id. Representatives get a MinHash signature of BANDS * ROWS
values; those equal in a band are candidates. A candidate pair is compared in batches of signature
values: after each batch, with a uniform prior on the similarity s and matches ~ Binomial(s), the
pair is dropped once P(s >= threshold) falls below MISS. Survivors are verified on the full sets.

No bucket is expanded into all its pairs. First each member is paired with the smallest member of
its bucket; links found join documents into components. Then only buckets that still hold several
components are compared, across components only, inside the task on signatures (large buckets as
pairs of blocks), and only survivors leave the task. A link inside a component can't change it, so
the components are those of all links.

Chance of losing a link of similarity exactly 0.75: (1 - 0.75^5)^36 = 6e-5 in banding, and MISS.

Cases: null or wordless text has an empty set and links with nothing; fewer than five words are one
shingle; rows that share an id are one node; a null id takes part in nothing (null component, kept);
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import (
    arrow_batches,
    connected_components,
    join_sized,
    materialize,
    min_labels,
    mix,
    partitions,
    release,
    run_key,
    split_blocks,
    text_blocks,
    whole_groups,
    windows,
    words,
)

SHINGLE, BANDS, ROWS, BATCH = 5, 36, 5, 36
HASHES = BANDS * ROWS
#: Share of the threshold in 100 * intersection >= THRESHOLD * union.
THRESHOLD, MISS = 75, 1e-6
#: Members of a bucket, and texts of a cluster, that are compared at once; larger ones go as blocks.
BLOCK, VERIFY_BLOCK = 256, 512
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[int]:
    """For each number of compared values, the fewest matches with which P(s >= threshold) >= miss."""
    out = []
    for m in range(BATCH, HASHES + 1, BATCH):
        tail, k = 0.0, 0
        for k in range(m + 1):
            tail += comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if tail >= miss:
                break
        out.append(k)
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the documents of a block, one after the other, and their bounds."""
    n = len(offs) - 1
    _, _, row, h = words(data, offs, lower=True, key=run_key())
    count = np.bincount(row, minlength=n)
    whole = windows(h, k)
    rows = row[: len(whole)]
    whole, rows = whole[row[k - 1 :] == rows] if len(whole) else whole, rows[row[k - 1 :] == rows] if len(whole) else rows
    first = np.cumsum(count) - count
    for few in range(1, k):
        at = np.flatnonzero(count == few)
        if len(at):
            v = np.zeros(len(at), np.uint64)
            for j in range(few):
                v = mix(v * np.uint64(31) + h[first[at] + j] + np.uint64(few))
            whole, rows = np.concatenate([whole, v]), np.concatenate([rows, at])
    order = np.lexsort((whole, rows))
    whole, rows = whole[order], rows[order]
    if len(whole):
        new = np.r_[True, (whole[1:] != whole[:-1]) | (rows[1:] != rows[:-1])]
        whole, rows = whole[new], rows[new]
    return whole, np.searchsorted(rows, np.arange(n + 1))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (digest of the set), sig (16 bits a hash), bands of every row."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"
    fields = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offs in text_blocks(batch.column(1)):
                s, at = shingle_sets(data, offs)
                n = np.diff(at)
                some = np.flatnonzero(n)
                sig = np.zeros((len(some), HASHES), np.uint64)
                k1, k2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                if len(some):
                    starts = at[:-1][some]
                    for a in range(HASHES):
                        v = s * _A[a]
                        v ^= v >> np.uint64(32)
                        sig[:, a] = np.minimum.reduceat(v, starts)
                    k1[some] = np.add.reduceat(mix(s + np.uint64(1)), starts)
                    k2[some] = np.add.reduceat(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                band = np.zeros((len(some), BANDS), np.uint64)
                for b in range(BANDS):
                    v = np.full(len(some), np.uint64(b + 1))
                    for r in range(ROWS):
                        v = mix(v ^ sig[:, b * ROWS + r]) + np.uint64(b)
                    band[:, b] = v
                short = mix(sig.ravel()).astype(np.uint16).reshape(sig.shape)
                sigs = [None] * (j - i)
                for q, x in zip(some.tolist(), short):
                    sigs[q] = x.tobytes()
                lens = np.zeros(j - i + 1, np.int32)
                lens[1:][some] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(lens, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sigs, pa.binary()), bands], schema=fields)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _survive(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the pairs of signature rows that no batch prunes."""
    alive, seen = np.arange(len(x)), np.zeros(len(x), np.int64)
    for b, need in enumerate(least):
        part = slice(b * BATCH, (b + 1) * BATCH)
        seen = seen + (x[alive, part] == y[alive, part]).sum(1)
        keep = seen >= need
        alive, seen = alive[keep], seen[keep]
        if not len(alive):
            break
    return alive


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def prune(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures leaves."""
    least = least_matches()
    own = signed.select(F.col("doc_id").alias("a"), F.col("sig").alias("x"))
    other = signed.select(F.col("doc_id").alias("b"), F.col("sig").alias("y"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keep = _survive(_signatures(batch.column("x")), _signatures(batch.column("y")), least)
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return pairs.join(own, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) among pairs: 100 * intersection >= THRESHOLD * union of the full sets."""
    spark = docs.sparkSession
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "mh")
    texts = join_sized(docs.select("doc_id", "text"), ids, "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").sortWithinPartitions("b")

    def run(batches):
        last, kept = None, None

        def sets(column):
            out = []
            for _, _, data, offs in text_blocks(column):
                s, at = shingle_sets(data, offs)
                out += [s[p:q] for p, q in zip(at, at[1:])]
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column("b").to_pylist()
            new = [k for k in range(len(b)) if k == 0 or b[k] != b[k - 1]]  # each right side once
            ys = dict(zip(new, sets(batch.column("y").take(pa.array(new)))))
            links = []
            for k, x in enumerate(sets(batch.column("x"))):
                kept = ys[k] if k in ys else kept
                both = len(np.intersect1d(x, kept, assume_unique=True))
                if 100 * both >= THRESHOLD * (len(x) + len(kept) - both):
                    links.append(k)
            yield batch.select(["a", "b"]).take(pa.array(links, pa.int64()))

    return both.mapInArrow(run, "a long, b long").distinct()


def across(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the members of a bucket that are in different components and survive
    pruning; a spanning forest of those pairs, not all of them.

    members: bkey, rep, c (component), n_shingles, sig. Members of a bucket's largest component don't meet each
    other: they come once for every BLOCK of the others (mostly one), and the others once for every BLOCK of
    them. The others meet among themselves, more than BLOCK of them as pairs of blocks.
    """
    spark = members.sparkSession
    least = least_matches()
    per = members.groupBy("bkey", "c").agg(F.count("*").alias("n")).groupBy("bkey").agg(
        F.max_by("c", F.struct("n", "c")).alias("_main"), F.max("n").alias("_n_main"), (F.sum("n") - F.max("n")).alias("_n_others"), F.count("*").alias("_n_c"))
    rows = join_sized(members, materialize(per, "mh"), "bkey", "inner").withColumn("main", F.col("c") == F.col("_main"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    own = F.when(F.col("main"), blocks("_n_main")).otherwise(blocks("_n_others"))
    other = F.when(F.col("main"), blocks("_n_others")).otherwise(blocks("_n_main"))
    cross = rows.withColumn("block", F.pmod(F.xxhash64("rep"), own).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), other - 1)))
    cross = cross.withColumns({
        "lo": F.when(F.col("main"), F.col("block")).otherwise(F.col("_other")), "hi": F.when(F.col("main"), F.col("_other")).otherwise(F.col("block")), "kind": F.lit(0)})
    among = split_blocks(rows.where(~F.col("main") & (F.col("_n_c") > 2)), "_n_others", "rep", BLOCK).withColumn("kind", F.lit(1))
    keys = ["bkey", "kind", "lo", "hi"]
    columns = [*keys, "main", "block", "rep", "c", "n_shingles", "sig"]
    rows = cross.select(*columns).unionByName(among.select(*columns))
    rows = rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "main")

    def compare(group: pa.Table, edge: np.ndarray):
        sig = _signatures(group.column("sig"))
        cols = {k: group.column(k).to_numpy() for k in ("kind", "lo", "hi", "block", "rep", "c", "n_shingles")}
        main, n = np.asarray(group.column("main")).astype(bool), len(sig)
        sizes = np.diff(np.r_[edge, n])
        end = np.repeat(np.r_[edge[1:], n], sizes)
        first_main = np.repeat(edge + np.add.reduceat(~main, edge), sizes)  # the others stand before them
        partner = np.where(cols["kind"] == 0, first_main, np.arange(n) + 1)
        ahead = np.where((cols["kind"] == 0) & main, 0, end - partner)  # rows that each row is compared with
        i, left, right = 0, [], []
        while i < n:
            j = max(i + 1, int(np.searchsorted(np.cumsum(ahead[i:]), 200_000, "right")) + i)
            x = np.repeat(np.arange(i, j), ahead[i:j])
            y = np.repeat(partner[i:j], ahead[i:j]) + np.arange(len(x)) - np.repeat(np.cumsum(ahead[i:j]) - ahead[i:j], ahead[i:j])
            few, many = cols["n_shingles"][x], cols["n_shingles"][y]
            ok = (cols["c"][x] != cols["c"][y]) & (100 * np.minimum(few, many) >= THRESHOLD * np.maximum(few, many))
            ok &= (cols["kind"][x] == 0) | (cols["lo"][x] == cols["hi"][x]) | (cols["block"][x] != cols["block"][y])
            x, y = x[ok], y[ok]
            keep = _survive(sig[x], sig[y], least) if len(x) else x
            left.append(x[keep])
            right.append(y[keep])
            i = j
        label = min_labels(n, np.concatenate(left), np.concatenate(right))
        some = np.flatnonzero(label != np.arange(n))
        yield pa.RecordBatch.from_arrays([pa.array(cols["rep"][some]), pa.array(cols["rep"][label[some]])], ["a", "b"])

    def run(batches):
        for group, edge in whole_groups(batches, keys):
            yield from compare(group, edge)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, by products of incidence matrices."""
    flat = np.concatenate([*x, *y])
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.r_[True, flat[1:] != flat[:-1]]) - 1 if len(flat) else owner
    shared = np.bincount(column) > 1
    column = (np.cumsum(shared) - 1)[column[keep := shared[column]]]
    owner = owner[keep]
    out = np.zeros((len(x), len(y)))
    step = 4096
    cut = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + step + 1, step))
    for k, (a, b) in enumerate(zip(cut, cut[1:])):
        inc = np.zeros((len(x) + len(y), step), np.float32)
        inc[owner[a:b], column[a:b] - k * step] = 1
        out += inc[: len(x)] @ inc[len(x) :].T
    return out


def verify_clusters(members: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the members of a cluster by links of their full sets.

    members: cluster, n_members, rep, text. Each text is sent once, or once for each pair of blocks.
    """
    spark = members.sparkSession
    keys = ["cluster", "lo", "hi"]
    rows = split_blocks(members, "n_members", "rep", VERIFY_BLOCK).select(*keys, "block", "rep", "text")
    rows = rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "block")

    def run(batches):
        for table, at in whole_groups(batches, keys, 200):
            sets = []
            for _, _, data, offs in text_blocks(table.column("text")):
                s, cut = shingle_sets(data, offs)
                sets += [s[p:q] for p, q in zip(cut, cut[1:])]
            rep, block, lo, hi = (table.column(k).to_numpy() for k in ("rep", "block", "lo", "hi"))
            for a, b in zip(at, [*at[1:], table.num_rows]):
                split = b if lo[a] == hi[a] else a + int(np.searchsorted(block[a:b], hi[a]))
                left, right = np.arange(a, split), np.arange(a if lo[a] == hi[a] else split, b)
                if not len(left) or not len(right):
                    continue
                size = np.array([len(s) for s in sets[a:b]])
                both = _intersections([sets[k] for k in left], [sets[k] for k in right]).astype(np.int64)
                close = 100 * both >= THRESHOLD * (size[left - a][:, None] + size[right - a][None, :] - both)
                i, j = np.nonzero(close)
                label = min_labels(b - a, left[i] - a, right[j] - a)
                some = np.flatnonzero(label != np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(rep[a:b][some]), pa.array(rep[a:b][label[some]])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    arrow_batches(docs.sparkSession)
    signed = materialize(sign(docs), "mh")
    slim = signed.select("doc_id", "n_shingles", "k1", "k2")
    linked = slim.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(linked.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "mh")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    signed_reps = materialize(
        signed.where("n_shingles > 0").join(reps, "doc_id", "left_semi").select("doc_id", "n_shingles", "sig", "bands"), "mh"
    )
    texts = docs.where("doc_id is not null")

    bands = signed_reps.select(F.explode("bands").alias("bkey"), F.col("doc_id").alias("rep"))
    groups = bands.groupBy("bkey").agg(F.count("*").alias("n_members"), F.min("rep").alias("lead")).where("n_members > 1")
    groups = materialize(groups, "mh")  # counted map-side first; the join can then split a hot bucket
    member = materialize(bands.join(groups, "bkey"), "mh")

    star = materialize(member.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), "mh")
    alive = materialize(prune(star, signed_reps), "mh")
    links = materialize(verify(alive, texts), "mh")
    first = materialize(connected_components(links), "mh")  # the components so far

    placed = member.join(first, member.rep == first.node, "left").select(
        "bkey", "n_members", "rep", F.coalesce("component", "rep").alias("c")
    )
    placed = materialize(placed, "mh")
    several = placed.groupBy("bkey").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bkey")
    mixed = placed.join(several, "bkey", "left_semi").join(
        signed_reps.select(F.col("doc_id").alias("rep"), "n_shingles", "sig"), "rep"
    )
    more = materialize(across(mixed), "mh")
    clusters = materialize(connected_components(more).withColumnsRenamed({"node": "rep", "component": "cluster"}), "mh")
    counts = clusters.groupBy("cluster").agg(F.count("*").alias("n_members"))
    inside = clusters.join(counts, "cluster")
    cluster_texts = join_sized(texts.select(F.col("doc_id").alias("rep"), "text"), materialize(inside, "mh"), "rep", "inner")
    all_links = links.union(verify_clusters(cluster_texts))
    comps = connected_components(all_links)
    for done in (signed_reps, groups, member, star, alive, links, first, placed, more, clusters):
        release(done)

    of_class = classes.join(comps, classes.rep == comps.node, "left").select(
        "k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("_c")
    )
    # equal ids with different texts are one node: the smallest component of the id's rows
    out = slim.join(of_class, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_c", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each component (of equal ids, every row stays)."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept._id), "left_semi")
