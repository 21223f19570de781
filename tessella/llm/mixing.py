"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights (a source's target stops at
`max_rate` times its tokens and the excess is shared again by weight), the repetition rate of a
source is target / tokens, and every document is emitted floor(rate) times plus once more if a
hash-seeded draw in [0, 1) falls below the fraction. Only per-source rows are shuffled, after a
partial sum in each task, so a source that holds a third of all rows costs no more than others.

Cases: null text has size 0; a null source is a source of its own, ordered last; sources of size 0
get target 0; equal rows draw equally; documents with a null id draw by their text; an empty table
gives an empty mix. Further columns are kept by mix_documents() and never touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import WORD_PATTERN, materialize, partitions

SEED = "mix-1"
#: Sources up to which the per-source table is broadcast; above it the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draw(doc_id, text, seed: str = SEED) -> F.Column:
    """Uniform in [0, 1): 13 hex digits of the md5 of seed and id."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """source, source_size, target from a table of source and size rows.

    The target is min(cap, level * weight) at the one level where targets add up to
    share * all sizes; each step caps the sources above their cap and shares the rest again.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = F.asc_nulls_last("source")
    per = materialize(
        per.repartitionByRange(partitions(spark), by_source).withColumn("pid", F.spark_partition_id()), "mix"
    )
    # global position of a source: its place in a range partition plus the counts of those before it
    before = per.groupBy("pid").agg(F.count("*").alias("n"))  # one row for each partition
    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("pid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("pid").orderBy(by_source)) - 1
    ranked = per.withColumn("own", own).join(F.broadcast(before), "pid")
    ranked = ranked.select("source", "source_size", (F.col("own") + F.col("base")).alias("at"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = materialize(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(max_rate)).alias("cap")), "mix"
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = 0.0, -1
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)),
            F.count_if(capped),
        ).first()
        if not row[1] or row[2] == n_capped:
            break
        n_capped, level = row[2], (share * total - row[0]) / row[1]
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def taken(docs: DataFrame, **how) -> DataFrame:
    """source, _size, _draw and further columns of docs in; adds source_size, target and _copies,
    how often the mix emits the row."""
    targets = source_targets(docs.select("source", F.col("_size").alias("size")), **how)
    targets = materialize(targets.select(F.col("source").alias("_s"), "source_size", "target"), "mix")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    out = docs.join(targets, docs.source.eqNullSafe(targets._s), "left").drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.withColumn("_copies", F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("long"))


def mix_sizes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, without carrying its text."""
    slim = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("_size"), draw(F.col("doc_id"), F.col("text")).alias("_draw")
    )
    out = taken(materialize(slim, "mix"), **how)
    return out.select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken")
    )


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    names = docs.columns
    whole = docs.select(
        "source", word_count(F.col("text")).alias("_size"), draw(F.col("doc_id"), F.col("text")).alias("_draw"),
        F.struct(*[docs[c] for c in names]).alias("_row"),
    )
    out = taken(whole, **how).where("_copies > 0")
    out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*[F.col("_row")[c].alias(c) for c in names])
