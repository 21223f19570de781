"""Pairwise rule matches and fuzzy record matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewest characters of a text that may stand inside another.
LEAST = 4


def fuzzy_equal(a: Column, b: Column, least: int = LEAST) -> Column:
    """Equal, or one of at least `least` characters inside the other (both already normalised)."""
    inside = ((F.length(b) >= least) & a.contains(b)) | ((F.length(a) >= least) & b.contains(a))
    return (a != "") & (b != "") & ((a == b) | inside)


def _grams(text: Column) -> Column:
    """Substrings of LEAST characters; a shorter text itself."""
    size = F.length(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(size - LEAST + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(LEAST)))
    return F.when(size < LEAST, F.array(text)).otherwise(F.array_distinct(every))


def named_by(names: DataFrame, rules: DataFrame, side: str) -> DataFrame:
    """_name, rule_no of the names that are fuzzily equal to that side of a rule.

    Of two fuzzily equal texts the first LEAST characters of one are a gram of the other, so candidates
    are joined by equality whatever the number of rules.
    """
    told = rules.select("rule_no", F.col(side).alias("_side"))
    begins = lambda c: F.substring(c, 1, LEAST)
    inside = names.select("_name", F.explode(_grams(F.col("_name"))).alias("_g")).join(told.withColumn("_g", begins("_side")), "_g")
    around = names.withColumn("_g", begins("_name")).join(told.select("rule_no", "_side", F.explode(_grams(F.col("_side"))).alias("_g")), "_g")
    both = inside.unionByName(around).where(fuzzy_equal(F.col("_side"), F.col("_name")))
    return both.select("_name", "rule_no").distinct()


def pair_rules(items: DataFrame, rules: DataFrame, list_id: str, place: str, name: str) -> DataFrame:
    """Pairs of items of a list that a rule names, either way round, each with its gravest rule.

    items: list_id, place, name; rules: first, second, level, severity, rule_no (unique). The distinct names are
    matched with the rules, then the items that a rule names first and second meet inside their list.
    """
    names = items.select(F.col(name).alias("_name")).distinct()

    def named(side: str, k: int) -> DataFrame:
        rows = items.select(list_id, F.col(place).alias(f"_p{k}"), F.col(name).alias("_name"))
        return rows.join(named_by(names, rules, side), "_name").withColumnRenamed("_name", f"_n{k}")

    met = named("first", 1).join(named("second", 2), [list_id, "rule_no"]).where("_p1 <> _p2")
    turned = F.col("_p1") > F.col("_p2")
    met = met.select(
        list_id, "rule_no", F.least("_p1", "_p2").alias("place_a"), F.greatest("_p1", "_p2").alias("place_b"),
        F.when(turned, F.col("_n2")).otherwise(F.col("_n1")).alias("name_a"), F.when(turned, F.col("_n1")).otherwise(F.col("_n2")).alias("name_b"))
    met = met.join(rules.select("rule_no", "level", "severity"), "rule_no")
    gravest = F.max_by(F.struct("level", "severity", "rule_no"), F.struct("severity", -F.col("rule_no")))
    pairs = met.groupBy(list_id, "place_a", "place_b", "name_a", "name_b").agg(gravest.alias("_r"))
    return pairs.select(list_id, "place_a", "place_b", "name_a", "name_b", "_r.level", "_r.severity", "_r.rule_no")


def rule_report(pairs: DataFrame, list_id: str, levels: list[str]) -> DataFrame:
    """For each list the number of pairs of each level and the worst level."""
    return pairs.groupBy(list_id).agg(
        F.max_by("level", "severity").alias("worst_level"), *[F.count_if(F.col("level") == v).alias(f"n_{v}") for v in levels])


def match_status(queries: DataFrame, candidates: DataFrame, query_id: str, query: str) -> DataFrame:
    """The record of each query: an exact name, else an exact second name, else the only candidate is
    validated; several go to review with the best; none is rejected.

    candidates: query_id, rank, item_id, name, alias (normalised), n_candidates.
    """
    q = queries.select(query_id, F.col(query).alias("_q"))
    c = candidates.join(q, query_id).withColumn(
        "_prio", F.when(F.col("name") == F.col("_q"), 0).when(F.col("alias") == F.col("_q"), 1).otherwise(2)
    )
    w = Window.partitionBy(query_id).orderBy("_prio", "rank", "item_id")
    best = c.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    status = F.when((F.col("_prio") < 2) | (F.col("n_candidates") == 1), "validated").otherwise("review")
    best = best.select(query_id, "item_id", status.alias("_s"))
    out = queries.select(query_id).join(best, query_id, "left")
    return out.select(query_id, "item_id", F.coalesce("_s", F.lit("rejected")).alias("match_status"))


def file_status(matches: DataFrame, by: str) -> DataFrame:
    """Counts of outcomes of a file, and its status: review while any is open."""
    g = matches.groupBy(by).agg(*[F.count_if(F.col("match_status") == s).alias(f"n_{s}") for s in ("validated", "review", "rejected")])
    return g.withColumn("file_status", F.when(F.col("n_review") > 0, "pending_review").otherwise("processed"))
