"""References of texts to articles, acts and dates as a typed table, and their way back to what they name.

A text's references stay in its row until they are told apart (no shuffle); then there is a row for each. Kinds are
`article`, `date` and those of ACTS; `number` is written alike whatever the text's spelling (`n° 2-18.5` and `2.18-5` are `2-18-5`),
so references meet what they name by equality of kind and number.

Cases: a null or empty text has no references; the same reference told twice in a text is one row, in two spellings two
rows with one number; a date that is none (31/2) has a null `on_date`; registered targets that share kind and number: the smallest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

from .rerank import ARTICLES, DATES, DOCUMENTS

# fixed values: first word of a reference to an act and its kind, articles that are told by a word, months
ACTS = {"loi": "law", "dahir": "dahir", "decret": "decree", "arrete": "order", "bo": "gazette", "مرسوم": "decree", "ظهير": "dahir"}
FIRST_ARTICLE = ("premier", "1er")
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")


#: So many registered targets are sent to every task; more meet the references by a shuffle.
MOST_SENT = 100_000


def _entries(kind: Column, found: Column) -> Column:
    return F.transform(found, lambda r: F.struct(kind.alias("family"), r.alias("ref")))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _date(ref: Column) -> Column:
    """Day, month, year, in digits or with the month's name; a year of two digits lies in 1970 to 2069."""
    part = lambda g: F.regexp_extract(ref, r"^(\d{1,2}) (\d{1,2}|\p{L}+) (\d{4}|\d{2})$", g)
    month = F.coalesce(F.try_element_at(_map({m: str(i + 1) for i, m in enumerate(MONTHS)}), part(2)), part(2))
    year = F.when(F.length(part(3)) == 4, part(3)).otherwise(F.concat(F.when(part(3) >= "70", F.lit("19")).otherwise(F.lit("20")), part(3)))
    return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(part(1), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def reference_table(texts: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, rank (articles, then acts, then dates, each by pattern and place, from 0), kind, ref (as normalised), number, on_date."""
    c = F.col(text)
    every = F.concat(
        _entries(F.lit("article"), T.find_all(c, ARTICLES, shape=lambda x: F.lower(F.trim(x)))),
        _entries(F.lit("act"), T.find_all(c, DOCUMENTS, shape=T.normalise_words)),
        _entries(F.lit("date"), T.find_all(c, DATES, shape=T.normalise_words)),
    )
    rows = texts.select(ident, F.posexplode(every).alias("rank", "_e")).select(ident, "rank", F.col("_e.family").alias("family"), F.col("_e.ref").alias("ref"))
    act = F.try_element_at(_map(ACTS), F.regexp_extract("ref", r"^[^\d\s]+", 0))
    article = F.when(F.col("ref").isin(*FIRST_ARTICLE), F.lit("1")).otherwise(T.arabic_digits(F.col("ref")))
    numbered = F.when(F.col("family") == "article", article).when(F.col("family") == "act", F.replace(F.regexp_extract("ref", r"\d[\d ]*$", 0), F.lit(" "), F.lit("-")))
    return rows.select(
        ident, "rank", F.when(F.col("family") == "act", act).otherwise(F.col("family")).alias("kind"), "ref",
        F.nullif(numbered, F.lit("")).alias("number"), F.when(F.col("family") == "date", _date(F.col("ref"))).alias("on_date"))


def resolve(references: DataFrame, registry: DataFrame) -> DataFrame:
    """references with target: what registry (kind, number, target) has under their kind and number, else null. Up to MOST_SENT known
    pairs go to the references, which then stay where they are."""
    known = registry.where("kind is not null and number is not null").groupBy("kind", "number").agg(F.min("target").alias("target"))
    if known.limit(MOST_SENT + 1).count() <= MOST_SENT:
        known = F.broadcast(known)
    return references.join(known, ["kind", "number"], "left").select(*references.columns, "target")


def with_references(chunks: DataFrame, ident: str, references: DataFrame) -> DataFrame:
    """chunks with what their resolved references tell: n_references, n_resolved, articles and acts (distinct, sorted), targets
    (distinct, sorted), first_date, last_date. Lists are as long as one text tells references."""
    names = lambda hit: F.array_sort(F.array_distinct(F.collect_list(F.when(hit, F.col("number")))))
    act = F.col("kind").isin(*set(ACTS.values()))
    told = references.groupBy(ident).agg(
        F.count("*").alias("n_references"), F.count("target").alias("n_resolved"), names(F.col("kind") == "article").alias("articles"),
        F.array_sort(F.collect_set(F.when(act, F.concat_ws(" ", "kind", "number")))).alias("acts"), F.array_sort(F.collect_set("target")).alias("targets"),
        F.min("on_date").alias("first_date"), F.max("on_date").alias("last_date"))
    out = chunks.join(told, ident, "left")
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("n_references", "n_resolved")}
    empty = {n: F.coalesce(n, F.array().cast(told.schema[n].dataType)) for n in ("articles", "acts", "targets")}
    return out.withColumns(zero | empty)
