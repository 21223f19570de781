"""Chunking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking as C
from tessella.operators import references as R
from tessella.sources.readers import spread, table

from .registry import query


def _paged(spark, d):
    """Documents as pages of one text each, lines as paragraphs."""
    page = F.struct(F.lit(1).alias("page_number"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("source").alias("title"), F.array(page).alias("pages"))


@query("ch06_wn08_paragraph_chunks", r"""
WITH RECURSIVE parts AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda p: trim(p)), lambda p: p <> '') AS p FROM documents),
walk(doc_id, i, chunk_no, open) AS (
  SELECT doc_id, CAST(1 AS BIGINT), 1, p[1] FROM parts WHERE len(p) > 0
  UNION ALL
  SELECT w.doc_id, w.i + 1, CASE WHEN length(w.open) + 1 + length(p[w.i + 1]) <= 1100 THEN w.chunk_no ELSE w.chunk_no + 1 END,
         CASE WHEN length(w.open) + 1 + length(p[w.i + 1]) <= 1100 THEN w.open || chr(10) || p[w.i + 1] ELSE p[w.i + 1] END
  FROM walk w JOIN parts USING (doc_id) WHERE w.i < len(p))
SELECT doc_id, chunk_no, arg_max(open, i) AS chunk FROM walk GROUP BY 1, 2""")
def paragraph_chunks(spark, d):
    return C.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text", separator="\n")


@query("ch01_ch02_ch03_section_chunks")
def section_chunks(spark, d):
    return C.section_chunks(_paged(spark, d), "doc_id", "title", "pages")


@query("ch04_ch05_structure_chunks")
def structure_chunks(spark, d):
    return C.structure_chunks(_paged(spark, d), "doc_id", "pages")


@query("ch07_enriched_chunks")
def enriched(spark, d):
    rules = {"obligations": [r"\bmust\b", r"\bthe\b"], "deadlines": [(r"(?i)\b\d+\s+(?:days|months|years)\b", 0)], "topics": [("@", ["contact"]), ("license", ["legal"])], "default_topic": "general"}
    out = C.enrich(C.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text", separator="\n"), "chunk", rules)
    return out.select("doc_id", "chunk_no", "summary", *[F.array_join(c, "|").alias(c) for c in ("obligations", "deadlines", "topics", "keywords")], "language")


def _level_sql(level, folds, pattern):
    """Rows of one pattern of STRUCTURE over the lines l."""
    flags = "c" if folds else "i"
    count = pattern.count("(") - pattern.count("(?")
    groups = ", ".join(f"nullif(trim(regexp_extract(l, '{pattern}', {g + 1}, '{flags}')), '')" for g in range(count))
    return f"SELECT doc_id, '{level}' AS level, trim(concat_ws(' ', {groups})) AS label FROM l WHERE regexp_matches(l, '{pattern}', '{flags}')"


@query("ch08_document_outline", "WITH l AS (SELECT doc_id, trim(unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)))) AS l FROM documents) "
    + " UNION ".join(_level_sql(*x) for x in C.STRUCTURE))
def document_outline(spark, d):
    """The outline of whole texts; the given documents hold no headings of these forms."""
    return C.outline(table(spark, d, "documents"), "doc_id", "text")


@query("ch09_preview")
def preview(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.array_join(C.preview(lines, lambda x: F.regexp_count(x, F.lit(r"\bthe\b"))), "\n").alias("preview"))


_WORDS = rf"regexp_extract_all(lower(coalesce(text, '')), '{T.WORD.replace(chr(39), chr(39) * 2)}')"


@query("ag14_ag17_top_words", f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS pos FROM documents),
g AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) >= 4 AND word NOT IN ('that', 'this', 'with') AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY 1, 2)
SELECT doc_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM g) WHERE rank <= 8""")
def top_words(spark, d):
    return C.top_words(spread(table(spark, d, "documents"), "doc_id"), "doc_id", "text", ["that", "this", "with"])


@query("ag17_distinct_ignoring_case", """
SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ',') AS names
FROM (SELECT p_partkey, string_split(p_name || ' ' || upper(p_type) || ' ' || p_type || ' ' || p_brand || ' ' || lower(p_brand), ' ') AS w FROM part)""")
def distinct_ignoring_case(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", F.upper("p_type"), "p_type", "p_brand", F.lower("p_brand")), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.distinct_texts_ci(words), ",").alias("names"))


# fixed values: sentences that are told apart, by the words that mark them
LINES = {
    "key_rules": [r"\bdoit\b", r"\best\b", r"\binterdit\b", r"\bne peut\b", "يجب", "يمنع", "لا يجوز"],
    "exceptions": [r"\bsauf\b", r"\btoutefois\b", r"\bexcept", "إلا", "غير أن"],
    "sanctions": [r"\bsanction\b", r"\bamende\b", r"\bsuspension\b", r"\bradiation\b", r"\bretrait\b", "غرامة", "عقوبة"],
    "definitions": ["on entend par", "est défini", "au sens de la présente loi", "يقصد", "تعني"],
}
WIDE = {
    "obligations": [r"\bmust\b", r"\bthe\b"], "deadlines": [(r"(?i)\b\d+\s+(?:days|months|years|jours|mois|ans)\b", 0)], "topics": [("@", ["contact"]), ("license", ["legal"])],
    "default_topic": "general", "translated": {"legal": ["droit"], "contact": ["adresse"]}, "lines": LINES,
}


@query("ch07_sf10_sf38_wide_chunks")
def wide_chunks(spark, d):
    """Paragraph chunks of whole documents as wide rows for search; lists joined by bars."""
    chunks = C.paragraph_chunks(spread(table(spark, d, "documents"), "doc_id"), "doc_id", "text", separator="\n", more=("source", "lang"))
    chunks = chunks.withColumns({"article": F.lit(None).cast("string"), "page": F.lit(1)})
    out = C.wide_chunks(chunks, "chunk", "source", "lang", "article", "page", "page", WIDE)
    lists = ("obligations", "deadlines", "topics", *LINES, "citations", "retrieval_keywords")
    return out.select("doc_id", "chunk_no", "summary", "language", "content_sha256", "citation_label", *[F.array_join(c, "|").alias(c) for c in lists])


def rulings(spark, d):
    """Orders as texts that name articles, acts and dates."""
    day = F.date_format("o_orderdate", "d/M/yyyy")
    text = F.concat(
        F.lit("Article "), F.col("o_custkey") % 40 + 1, F.lit(" de la Loi n° "), F.col("o_orderkey") % 50, F.lit("-18 du "), day, F.lit("; voir art. premier, l'art. "), F.col("o_custkey") % 7,
        F.lit(", le Décret n° 2-"), F.col("o_orderkey") % 30, F.lit("."), F.col("o_custkey") % 97, F.lit(" et BO "), F.col("o_orderkey") % 500, F.lit(" du 3 mars 2001; الظهير شريف رقم 1-"), F.col("o_custkey") % 9, F.lit(" المادة ٣"))
    return spread(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", text.alias("text"))


def acts(spark, d):
    """Parts as the decrees and laws that texts refer to."""
    p = table(spark, d, "part")
    decrees = p.select(F.lit("decree").alias("kind"), F.concat_ws("-", F.lit("2"), (F.col("p_partkey") % 30).cast("string"), F.col("p_size").cast("string")).alias("number"), F.col("p_partkey").alias("target"))
    return decrees.unionByName(p.where("p_partkey % 3 = 0").select(F.lit("law").alias("kind"), F.concat(F.col("p_size").cast("string"), F.lit("-18")).alias("number"), F.col("p_partkey").alias("target")))


_RULINGS = """t AS (SELECT o_orderkey, 'Article ' || (o_custkey % 40 + 1) || ' de la Loi n° ' || (o_orderkey % 50) || '-18 du ' || strftime(o_orderdate, '%-d/%-m/%Y') || '; voir art. premier, l''art. ' || (o_custkey % 7)
 || ', le Décret n° 2-' || (o_orderkey % 30) || '.' || (o_custkey % 97) || ' et BO ' || (o_orderkey % 500) || ' du 3 mars 2001; الظهير شريف رقم 1-' || (o_custkey % 9) || ' المادة ٣' AS text FROM orders)"""


def _found_sql() -> str:
    """family, pattern, place and ref of every match in t."""
    out = []
    families = (("article", R.ARTICLES, "lower(trim({}))"), ("act", R.DOCUMENTS, "{}"), ("date", R.DATES, "{}"))
    tidy = "trim(regexp_replace(regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for f, (family, patterns, shape) in enumerate(families):
        for k, (p, g) in enumerate(patterns):
            body, flags = (p.split(")", 1)[1], "i") if p.startswith("(?i") else (p, "c")
            hit = f"regexp_extract_all(text, '{body}', {g}, '{flags}')"
            shaped = shape.format("r") if f == 0 else tidy.format("r")
            out.append(f"SELECT o_orderkey, '{family}' AS family, {f} AS f, {k} AS p, i, {shaped} AS ref FROM (SELECT o_orderkey, unnest({hit}) AS r, generate_subscripts({hit}, 1) AS i FROM t)")
    return " UNION ALL ".join(out)


_REFERENCES = f"""{_RULINGS}, f AS ({_found_sql()}), o AS (SELECT o_orderkey, family, ref, min(f * 1000000 + p * 1000 + i) AS pos FROM f WHERE ref <> '' GROUP BY ALL),
n AS (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) - 1 AS INTEGER) AS rank, family, ref FROM o),
m(name, month) AS (VALUES {', '.join(f"('{x}', {i + 1})" for i, x in enumerate(R.MONTHS))}), k(word, kind) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in R.ACTS.items())}),
refs AS (SELECT o_orderkey, rank, CASE family WHEN 'act' THEN kind ELSE family END AS kind, ref,
 CASE family WHEN 'article' THEN CASE WHEN ref IN ('premier', '1er') THEN '1' ELSE translate(ref, '٠١٢٣٤٥٦٧٨٩', '0123456789') END WHEN 'act' THEN replace(regexp_extract(ref, '[0-9][0-9 ]*$'), ' ', '-') END AS number,
 CASE WHEN family = 'date' THEN make_date(CAST(split_part(ref, ' ', 3) AS BIGINT), coalesce(month, TRY_CAST(split_part(ref, ' ', 2) AS BIGINT)), CAST(split_part(ref, ' ', 1) AS BIGINT)) END AS on_date
 FROM n LEFT JOIN k ON family = 'act' AND word = regexp_extract(ref, '^[^0-9 ]+') LEFT JOIN m ON family = 'date' AND name = split_part(ref, ' ', 2)),
acts AS (SELECT kind, number, min(target) AS target FROM (SELECT 'decree' AS kind, '2-' || (p_partkey % 30) || '-' || p_size AS number, p_partkey AS target FROM part
 UNION ALL SELECT 'law', p_size || '-18', p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY 1, 2),
resolved AS (SELECT refs.*, target FROM refs LEFT JOIN acts USING (kind, number))"""


@query("sf10_ch07_reference_table", f"WITH {_REFERENCES} SELECT * FROM resolved")
def reference_rows(spark, d):
    """A row for each reference of each text, with the act it names where that is known."""
    return R.resolve(R.reference_table(rulings(spark, d), "o_orderkey", "text"), acts(spark, d))


@query("ch07_sf10_linked_texts", f"""
WITH {_REFERENCES} SELECT o_orderkey, count(*) AS n_references, count(target) AS n_resolved, array_to_string(list_sort(list_distinct(list(number) FILTER (WHERE kind = 'article'))), '|') AS articles,
 array_to_string(list_sort(list_distinct(list(kind || ' ' || number) FILTER (WHERE kind NOT IN ('article', 'date')))), '|') AS acts,
 coalesce(array_to_string(list_sort(list_distinct(list(target) FILTER (WHERE target IS NOT NULL))), '|'), '') AS targets, min(on_date) AS first_date, max(on_date) AS last_date FROM resolved GROUP BY 1""")
def linked_texts(spark, d):
    """Each text with what its references tell, joined back to it."""
    out = R.with_references(rulings(spark, d), "o_orderkey", reference_rows(spark, d)).drop("text")
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("articles", "acts", "targets")})
