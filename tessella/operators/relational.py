"""Relational operators: filters, joins, aggregates, ranking, set operations.

Each takes DataFrames and parameters and returns a DataFrame; nothing is collected and no clock is
read (`now` is a parameter). Every order has an explicit tie-break, so results are repeatable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- filters


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to each value that is given (None: not asked)."""
    asked = [F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, asked)) if asked else df


def where_contains(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows of which any column contains text, whatever the case."""
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def where_days(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Rows of the days from first to last, the whole last day included."""
    if first:
        df = df.where(F.col(column) >= F.lit(first).cast("timestamp"))
    if last:
        df = df.where(F.col(column) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))
    return df


def not_expired(df: DataFrame, column: str, now: str) -> DataFrame:
    return df.where(F.col(column) > F.lit(now).cast("timestamp"))


def errors_of(rules: dict[str, Column]) -> Column:
    """Map of field -> message for the rules (a null rule holds)."""
    every = F.create_map(*[x for k, c in rules.items() for x in (F.lit(k), c)])
    return F.map_filter(every, lambda k, v: v.isNotNull())


def threshold_alert(quantity: Column, least: Column, flag: Column | None = None) -> Column:
    """ok, low or out: out of stock at 0, low when flagged or at most the minimum."""
    low = quantity <= least
    low = low if flag is None else low | F.coalesce(flag, F.lit(False))
    return F.when(quantity == 0, "out").when(low, "low").otherwise("ok")


def restricted(requires: Column, role: Column, free: str) -> Column:
    """True where a role is told, is asked for, and is not the free one."""
    return F.coalesce(requires & role.isNotNull() & (role != free), F.lit(False))


# ---------------------------------------------------------------- joins


def lookup(df: DataFrame, table: DataFrame, on: str, defaults: dict[str, object], small: bool = False) -> DataFrame:
    """Left join with defaults for what is not found. small: the table has a known small bound."""
    out = df.join(F.broadcast(table) if small else table, on, "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def eligible(candidates: DataFrame, key: str, sent: DataFrame, consented: DataFrame) -> DataFrame:
    """Distinct candidates that were not sent to and have consented."""
    return candidates.select(key).distinct().join(sent, key, "left_anti").join(consented, key, "left_semi")


def classify_candidates(candidates: DataFrame, key: str, sent: DataFrame, consented: DataFrame) -> DataFrame:
    """class of each distinct candidate, the first that holds: already_sent, no_consent, eligible."""
    a = sent.select(F.col(key), F.lit(True).alias("_sent")).distinct()
    b = consented.select(F.col(key), F.lit(True).alias("_ok")).distinct()
    got = candidates.select(key).distinct().join(a, key, "left").join(b, key, "left")
    kind = F.when(F.col("_sent"), "already_sent").when(F.col("_ok").isNull(), "no_consent").otherwise("eligible")
    return got.select(key, kind.alias("class"))


def fuse_ranked(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of two ranked lists; scores missing on a side are null."""
    return left.join(right, on, "full_outer")


def override(base: DataFrame, layers: list[DataFrame], on: str, columns: list[str]) -> DataFrame:
    """Columns of base, overridden by those of each layer in turn where they are not null."""
    out = base
    for i, layer in enumerate(layers):
        told = layer.select(on, *[F.col(c).alias(f"_{i}_{c}") for c in columns])
        out = out.join(told, on, "left").withColumns({c: F.coalesce(f"_{i}_{c}", c) for c in columns}).drop(*[f"_{i}_{c}" for c in columns])
    return out


# ---------------------------------------------------------------- aggregates


def counts(df: DataFrame, conditions: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """How many rows fulfil each condition, in one pass."""
    aggs = [F.count_if(c).alias(k) for k, c in conditions.items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def count_by(df: DataFrame, column: str, unknown: str = "unknown", out: str = "n") -> DataFrame:
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown))
    return df.groupBy(value.alias(column)).agg(F.count("*").alias(out))


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order (which must have no ties), as one hash aggregate."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def inverted_index(df: DataFrame, key: str, members: dict[str, str]) -> DataFrame:
    """key, and for each named column the sorted distinct values."""
    return df.groupBy(key).agg(*[F.array_sort(F.collect_set(c)).alias(k) for k, c in members.items()])


def duplicate_groups(df: DataFrame, key: str, ident: str, agree: str) -> DataFrame:
    """Keys with several rows: ids, how many, and high confidence if `agree` is the same in all."""
    g = df.groupBy(key).agg(
        F.array_sort(F.collect_list(ident)).alias("ids"), F.count("*").alias("n"), F.count_distinct(agree).alias("_d"))
    return g.where("n > 1").select(key, "ids", "n", F.when(F.col("_d") == 1, "high").otherwise("medium").alias("confidence"))


def total_score(parts: list[str], total: str | None = None, least: int = 50) -> dict[str, Column]:
    """score (the given total, else the sum, within 0 and 100) and flagged (below least)."""
    summed = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in parts])
    told = F.coalesce(F.nullif(F.col(total), F.lit(0)), summed) if total else summed
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.round(told))).cast("int")
    return {"score": score, "flagged": score < least}


# ---------------------------------------------------------------- ranking


def top_rows(df: DataFrame, order: list, n: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(n)


def top_by(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group and their rank (ranks beyond n are dropped before the shuffle)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def batch_numbers(df: DataFrame, by: list[str], order: list, size: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("batch_number", F.floor((n - 1) / size).cast("int") + 1)


def numbered_ids(df: DataFrame, by: str, order: list, template: str = "%s__chunk_%03d") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("chunk_id", F.format_string(template, F.col(by).cast("string"), n))


def carry_forward(df: DataFrame, by: list[str], order: list, marker: Column, value: Column, out: str) -> DataFrame:
    """The value of the last row where marker holds, this one included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(marker, value), ignorenulls=True).over(w))


def segments(df: DataFrame, by: list[str], order: list, boundary: Column, out: str = "segment") -> DataFrame:
    """Number of the segment that a row is in; a boundary begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(boundary, 1).otherwise(0)).over(w))


def unique_slugs(df: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """unique_id: row by row in order, the slug, or the first of slug-1, slug-2, ... that no row before took.

    Within a slug that is a row number. Only where a numbered form is itself the slug of some row do rows of
    different slugs meet; just those slugs are counted through row by row, by the slug without its numbers.
    """
    numbered = r"-[1-9][0-9]*$"
    slugs = df.select(F.col(slug).alias("_slug")).distinct()
    up = slugs.where(F.col("_slug").rlike(numbered)).select(F.col("_slug").alias("_low"), F.regexp_replace("_slug", numbered, "").alias("_slug"))
    pairs = up.join(slugs, "_slug", "left_semi")
    meets = pairs.select("_slug").union(pairs.select("_low")).distinct()
    n = F.row_number().over(Window.partitionBy(slug).orderBy(*order)) - 1
    plain = df.join(meets, F.col(slug) == meets._slug, "left_anti")
    plain = plain.withColumn("unique_id", F.when(n == 0, F.col(slug)).otherwise(F.concat_ws("-", slug, n.cast("string"))))
    shared = df.join(meets, F.col(slug) == meets._slug, "left_semi").withColumn("_root", F.regexp_replace(slug, r"(-[1-9][0-9]*)+$", ""))

    def through(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        taken, free_from, out = set(), {}, []
        for s in pdf[slug]:
            k = free_from.get(s, 0)
            while (name := f"{s}-{k}" if k else s) in taken:
                k += 1
            free_from[s] = k + 1
            taken.add(name)
            out.append(name)
        return pdf.drop(columns="_root").assign(unique_id=out)

    schema = plain.schema
    return plain.unionByName(shared.groupBy("_root").applyInPandas(through, schema))


def fit_budget(blocks: Column, budget: int, joint: int = 2) -> Column:
    """Blocks that fit in a budget of characters, in order: one that does not fit is skipped, later ones may."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))
    step = lambda acc, b: F.when(
        acc["used"] + F.length(b) <= budget,
        F.struct(F.concat(acc["kept"], F.array(b)).alias("kept"), (acc["used"] + F.length(b) + joint).alias("used")),
    ).otherwise(acc)
    return F.aggregate(blocks, start, step, lambda acc: acc["kept"])


# ---------------------------------------------------------------- sets


def feed(parts: list[DataFrame], order: list) -> DataFrame:
    """Union by name (missing columns are null), sorted."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy(*order)


def first_source(parts: list[DataFrame], key: str) -> DataFrame:
    """Union in which of equal keys the row of the first part stays."""
    tagged = [p.withColumn("_prio", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    return keep_first(every, [key], ["_prio"]).drop("_prio")


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def shared_tokens_counted(a: Column, b: Column) -> Column:
    """Tokens of a that are in b, repeats of a counted."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x)))
