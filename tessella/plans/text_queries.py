"""Text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import quality as Q
from tessella.operators import retrieval as S
from tessella.sources.readers import spread, table

from .registry import query

_WS = r"' \t\n\r'"
#: N1 in SQL, good for the letters of the driver's documents.
_N1 = r"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"
N1 = _N1.format(c="text")
_N2 = r"regexp_replace(trim(lower(strip_accents(coalesce(text, ''))), chr(32) || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g')"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("sf01_normalise_words", f"SELECT doc_id, {N1} AS n1 FROM documents")
def normalise_words(spark, d):
    return _docs(spark, d).select("doc_id", T.normalise_words(F.col("text")).alias("n1"))


@query("sf02_sf03_normalise_text", f"SELECT doc_id, {_N2} AS n2, trim(lower(strip_accents(coalesce(text, ''))), chr(32) || chr(9) || chr(10) || chr(13)) AS n3 FROM documents")
def normalise_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalise_text(F.col("text")).alias("n2"), T.normalise_search(F.col("text")).alias("n3"))


@query("sf04_sf05_tokens", f"""
SELECT doc_id, len(list_filter(string_split({N1}, ' '), lambda t: length(t) > 1)) AS n_tokens,
 len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> '')) AS n_ascii FROM documents""")
def tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.ascii_tokens(F.col("text"))).cast("long").alias("n_ascii"))


@query("sf06_sf07_word_counts", r"""
SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS n_unicode,
 len(regexp_extract_all(coalesce(text, ''), '[\x{0600}-\x{06FF}A-Za-zÀ-ÿ0-9][\x{0600}-\x{06FF}A-Za-zÀ-ÿ0-9''’\-]{1,}')) AS n_words FROM documents""")
def word_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.unicode_tokens(F.col("text"))).cast("long").alias("n_unicode"), T.word_count(F.col("text")).cast("long").alias("n_words"))


_STOP = ["the", "and", "die", "der", "les", "des", "que"]
_EXPAND = [("mail", ["contact", "address"]), ("license|licence", ["license", "rights"]), ("phone|tel", ["contact"])]


@query("sf08_sf09_topical_and_expanded")
def topical(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.array_join(T.topical_tokens(t, _STOP), " ").alias("topical"), F.size(T.expand_tokens(t, F.col("text"), _EXPAND)).alias("n_expanded"))


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("sf10_sf46_references", rf"""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '{_MAIL}'))), ' ') AS mails,
 coalesce(nullif(regexp_extract(text, '{_MAIL}'), ''), '-') AS first_mail,
 len(list_distinct(regexp_extract_all(coalesce(text, ''), '\b\d{{3}}-\d{{4}}\b'))) AS n_numbers FROM documents""")
def references(spark, d):
    found = T.find_all(F.col("text"), [(_MAIL, 0)])
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(found), " ").alias("mails"),
        F.coalesce(T.first_match(F.col("text"), [(_MAIL, 0)]), F.lit("-")).alias("first_mail"), F.size(T.find_all(F.col("text"), [(r"\b\d{3}-\d{4}\b", 0)])).cast("long").alias("n_numbers"))


_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS p, unnest(regexp_extract_all(t, '(?i){p}')) AS r, generate_subscripts(regexp_extract_all(t, '(?i){p}'), 1) AS k FROM t" for i, p in enumerate(T.CROSS_REFERENCES))


@query("sf11_cross_references", rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, p, k, trim(regexp_replace(regexp_replace(r, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS r FROM ({_FOUND})),
o AS (SELECT doc_id, r, min(p * 1000000 + k) AS k FROM f GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM o)
SELECT doc_id, coalesce(string_agg(r, '|' ORDER BY k), '') AS refs FROM documents LEFT JOIN (SELECT * FROM n WHERE n <= 20) USING (doc_id) GROUP BY 1""")
def cross_references(spark, d):
    """References between texts; the given documents hold none of these forms."""
    return _docs(spark, d).select("doc_id", F.array_join(T.cross_references(F.col("text")), "|").alias("refs"))


@query("sf12_sf13_sf14_sentences")
def sentence_lines(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", F.size(T.sentences(c)).alias("n_sentences"), F.array_join(T.key_lines(c, [r"\bthe\b", r"\bder\b"], 3), "|").alias("key_lines"),
        F.array_join(T.find_all(c, [(r"(?i)\b\d+\s+(?:days|months|years)\b", 0), (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 0)], 8), "|").alias("deadlines"))


_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[*_`#>-]+', ' ', 'g'), '\[([^\n\r]*?)\]\([^\n\r]*?\)', '\1', 'g'), '\s+', ' ', 'g'))"


@query("sf15_sf16_sf42_summaries", rf"""
SELECT doc_id, substr(one, 1, 280) AS summary, CASE WHEN length(plain) > 40 THEN trim(substr(plain, 1, 39)) || '…' ELSE plain END AS clipped,
 CASE WHEN length(substr(one, 1, 60)) > 40 THEN trim(substr(one, 1, 39)) || '...' ELSE substr(one, 1, 60) END AS dotted
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS one, {_PLAIN} AS plain FROM documents)""")
def summaries(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", T.one_line(c, 280).alias("summary"), T.clip(T.strip_markdown(c), 40).alias("clipped"), T.clip(T.one_line(c, 60), 40, "...").alias("dotted"))


@query("sf17_languages", r"""
SELECT doc_id, CASE WHEN ar > 20 AND la > 20 THEN 'mixed' WHEN ar > 20 THEN 'ar' WHEN la > 20 THEN 'fr' ELSE 'unknown' END AS by_count,
 CASE WHEN ar > 0 THEN 'ar' WHEN regexp_matches(text, '[ñÑ¿¡]') THEN 'es' WHEN ru > 0 THEN 'ru' ELSE 'fr' END AS by_letter FROM (
 SELECT doc_id, text, len(regexp_extract_all(text, '[\x{0600}-\x{06FF}]')) AS ar, len(regexp_extract_all(text, '\p{L}')) - len(regexp_extract_all(regexp_replace(text, '[\x{0000}-\x{05FF}]', '', 'g'), '\p{L}')) AS la, len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')) AS ru FROM documents)""")
def languages(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", T.script_language(c).alias("by_count"), F.when(c.contains("Ñ"), "es").otherwise(T.letter_language(c)).alias("by_letter"))


@query("sf18_sf19_sf40_rules", """
SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'reserved') THEN 'notice' ELSE 'other' END AS doc_type,
 CASE WHEN contains(lower(text), '@') AND contains(lower(text), 'license') THEN 'contact,legal' WHEN contains(lower(text), '@') THEN 'contact' WHEN contains(lower(text), 'license') THEN 'legal' ELSE 'general' END AS topics FROM documents""")
def rules(spark, d):
    low = F.lower("text")
    return _docs(spark, d).select("doc_id", T.first_rule(low, [("license", "license"), ("reserved", "notice")], "other").alias("doc_type"),
        F.array_join(T.all_rules(low, [("@", ["contact"]), ("license", ["legal"])], "general"), ",").alias("topics"))


@query("sf20_sf21_ag10_document_quality")
def document_quality(spark, d):
    """Every document as one page; a document without text has no page."""
    docs = spread(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return Q.document_quality(docs.where("text is not null"), "doc_id", documents=docs)


@query("sf24_ag09_page_rollup", """
SELECT conv_id, count(*) AS n_pages, count(*) FILTER (length(text) < 80) AS n_low, count(*) FILTER (length(text) BETWEEN 80 AND 200) AS n_medium,
 CASE WHEN count(*) FILTER (length(text) < 80) * 2 >= count(*) THEN 'low' WHEN count(*) FILTER (length(text) <= 200) > 0 THEN 'medium' ELSE 'high' END AS quality,
 count(*) FILTER (length(text) < 80) || '/' || count(*) AS ratio,
 NOT (count(*) FILTER (length(text) < 80) * 2 < count(*) AND count(*) FILTER (length(text) <= 200) = 0) AS review FROM conversations GROUP BY 1""")
def page_rollup(spark, d):
    n = F.length("text")
    return Q.rollup_pages(table(spark, d, "conversations").withColumn("quality", F.when(n < 80, "low").when(n <= 200, "medium").otherwise("high")), "conv_id")


@query("sf22_sf23_clean", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([A-Za-zÀ-ÿ])-\n([A-Za-zÀ-ÿ])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10)) AS cleaned FROM documents""")
def clean(spark, d):
    return _docs(spark, d).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query("sf25_slugs", r"""
SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^0-9a-z]+', '-', 'g'), '-') AS slug FROM documents""")
def slugs(spark, d):
    return _docs(spark, d).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("sf28_sf29_hashes", "SELECT doc_id, substr(sha256(text), 1, 16) AS h16, replace(replace(rtrim(base64(encode(source)), '='), '+', '-'), '/', '_') AS id64 FROM documents")
def hashes(spark, d):
    return _docs(spark, d).select("doc_id", T.short_hash(F.col("text")).alias("h16"), T.base64url(F.col("source")).alias("id64"))


@query("sf30_signed_tokens")
def signed_tokens(spark, d):
    payload = F.to_json(F.struct(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 10).alias("exp")))
    df = table(spark, d, "customer").select("c_custkey", T.signed_token(payload, "not-a-secret").alias("token"))
    return df.select("c_custkey", "token", T.token_payload(F.col("token"), "not-a-secret", 5000).isNotNull().alias("valid"))


@query("sf31_hash_vectors", """
WITH r AS (SELECT p_partkey, list_transform(range(40), lambda i: CAST('0x' || substr(sha256(p_name), CAST(i % 32 * 2 + 1 AS INTEGER), 2) AS INTEGER) / 255.0::DOUBLE * 2 - 1) AS r FROM part),
n AS (SELECT p_partkey, r, sqrt(list_sum(list_transform(r, lambda x: x * x))) AS n FROM r)
SELECT p_partkey, array_to_string(list_transform(r, lambda x: printf('%.6f', round(x / n, 6))), ' ') AS vector FROM n""")
def hash_vectors(spark, d):
    v = T.hash_vector(F.col("p_name"), 40)
    return spread(table(spark, d, "part"), "p_partkey").select("p_partkey", F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x)), " ").alias("vector"))


@query("sf32_cosine_to_queries", """
SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q""")
def cosine_to_queries(spark, d):
    e = spread(table(spark, d, "embeddings"), "vec_id")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated queries, against all rows
    return S.cosines(e, q, "vec_id", "embedding", "query_id")


@query("sf33_overlap_ratio_to_queries", f"""
WITH q AS (SELECT item_id, list_distinct(list_filter(string_split({N1}, ' '), lambda t: length(t) > 1)) AS toks FROM benchmark WHERE item_id % 100 = 0)
SELECT item_id, doc_id, round(len(list_filter(toks, lambda t: contains(n, t))) / len(toks), 6) AS ratio FROM (SELECT doc_id, {N1} AS n FROM documents), q""")
def overlap_to_queries(spark, d):
    from tessella.functions.vectors import overlap_ratio

    q = table(spark, d, "benchmark").where("item_id % 100 = 0").select("item_id", T.tokens(F.col("text")).alias("toks"))
    n = _docs(spark, d).select("doc_id", T.normalise_words(F.col("text")).alias("n"))
    return n.crossJoin(F.broadcast(q)).select("item_id", "doc_id", F.round(overlap_ratio(F.col("toks"), F.col("n")), 6).alias("ratio"))  # the stated queries


@query("sf34_sf35_sf36_labelled_texts", """
SELECT p_partkey, p_name || chr(10) || 'Brand: ' || p_brand || CASE WHEN p_size > 25 THEN chr(10) || 'Type: ' || p_type ELSE '' END AS labelled,
 p_name || ' — ' || p_brand || ' — art. ' || p_size || CASE WHEN p_size % 2 = 0 THEN ' — p. ' || p_size || '-' || (p_size + 1) ELSE ' — p. ' || p_size END AS citation FROM part""")
def labelled_texts(spark, d):
    p = table(spark, d, "part")
    big = F.when(F.col("p_size") > 25, F.col("p_type"))
    size = F.col("p_size").cast("string")
    last = F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    return p.select("p_partkey", T.labelled_text((None, F.col("p_name")), ("Brand", F.col("p_brand")), ("Type", big)).alias("labelled"),
        T.citation_label(F.col("p_name"), F.col("p_brand"), size, F.col("p_size"), last).alias("citation"))


@query("sf37_first_patterns", r"""
SELECT page_id, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '-') AS title, coalesce(nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), ''), '-') AS lang FROM pages""")
def first_patterns(spark, d):
    c = F.col("html")
    return table(spark, d, "pages").select("page_id", F.coalesce(T.first_match(c, [("<title>([^<]*)</title>", 1), ("<h1>([^<]*)</h1>", 1)]), F.lit("-")).alias("title"), F.coalesce(T.first_match(c, [('lang="([a-z]+)"', 1)]), F.lit("-")).alias("lang"))


_TRANSLATED = {"en": ["english", "anglais"], "de": ["german", "deutsch"], "fr": ["french", "français"], "es": ["spanish"]}
_LETTERS = r"[A-Za-zÀ-ÿ\x{0600}-\x{06FF}]"


@query("sf38_sf39_keyword_sets", rf"""
WITH k AS (SELECT doc_id, text, list_concat([lang], CASE lang {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _TRANSLATED.items())} ELSE [] END,
  list_transform(regexp_extract_all(source, '{_LETTERS}{{3,}}'), lambda x: lower(x)), list_transform(regexp_extract_all(substr(text, 1, 300), '{_LETTERS}{{4,}}'), lambda x: lower(x))) AS w FROM documents)
SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_filter(w, lambda x: x <> '' AND length(x) <= 80))), 1, 30), ',') AS keywords,
 concat_ws('|', CASE WHEN contains(lower(text), 'license') THEN 'Which license?' END, CASE WHEN contains(lower(text), '@') THEN 'Whom to write to?' END, CASE WHEN contains(lower(text), 'the') THEN 'What is said?' END) AS questions FROM k""")
def keyword_sets(spark, d):
    c = F.col("text")
    low = F.lower(c)
    ask = F.filter(F.array(F.when(low.contains("license"), "Which license?"), F.when(low.contains("@"), "Whom to write to?"), F.when(low.contains("the"), "What is said?")), lambda x: x.isNotNull())
    translated = F.create_map(*[x for k, v in _TRANSLATED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("lang")]
    words = T.keyword_set(F.array("lang"), translated, F.col("source"), F.lit(""), F.lit(None).cast("string"), c)
    return _docs(spark, d).select("doc_id", F.array_join(words, ",").alias("keywords"), F.array_join(F.slice(ask, 1, 5), "|").alias("questions"))


@query("sf41_sf44_sf45_escapes", """
SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped, substr(trim(regexp_replace(html, '\\s+', ' ', 'g')), 1, 50) AS line FROM pages""")
def escapes(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_escape(T.arabic_digits(F.col("url"))).alias("escaped"), T.one_line(F.col("html"), 50).alias("line"))


@query("sf43_plain_text", f"SELECT doc_id, {_PLAIN} AS plain FROM documents")
def plain_text(spark, d):
    return _docs(spark, d).select("doc_id", T.strip_markdown(F.col("text")).alias("plain"))


@query("sf43_html_text")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_markdown(T.strip_tags(F.col("html"))).alias("text"))


@query("sf47_sf53_labels", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day, 'Order ' || o_orderkey || ' of ' || o_custkey AS label FROM orders")
def labels(spark, d):
    o = table(spark, d, "orders")
    values = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("who"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", T.date_label(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), T.template(F.lit("Order {id} of {who}"), values).alias("label"))


@query("sf48_sf49_lists", r"""
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: length(x) >= 3), '|') AS items FROM part""")
def lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.split_list(F.replace("p_name", F.lit(" "), F.lit(" , "))), "|").alias("items"))


@query("sf52_xor_hash", """
SELECT doc_id, printf('%x', list_reduce(list_concat([5381::UBIGINT], list_transform(string_split(source, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: xor(h * 33 % 4294967296, c))) AS h FROM documents""")
def xor_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.xor_hash32(F.col("source")).alias("h"))


@query("sf54_sf55_sf56_intents", r"""
SELECT doc_id, regexp_matches(n, '\b(the|of)\b') AS asks_the, CASE WHEN regexp_matches(n, '\bder\b') THEN 'de' WHEN regexp_matches(n, '\bque\b') THEN 'romance' ELSE 'none' END AS intent FROM (SELECT doc_id, """ + N1 + " AS n FROM documents)")
def intents(spark, d):
    n = _docs(spark, d).select("doc_id", T.normalise_words(F.col("text")).alias("n"))
    return n.select("doc_id", F.col("n").rlike(r"\b(the|of)\b").alias("asks_the"), F.when(F.col("n").rlike(r"\bder\b"), "de").when(F.col("n").rlike(r"\bque\b"), "romance").otherwise("none").alias("intent"))


_ALIASES = [(["Short answer", "Useful answer"], "Answer"), (["Foundation", "Basis"], "Basis"), (["Sources", "Source"], "Sources")]


@query("sf58_sf60_heading_lines")
def heading_lines(spark, d):
    """Every line of every text after the alias rewrite; the line's number begins with 0."""
    text = T.rewrite_headings(F.col("text"), _ALIASES)
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "l")).withColumn("l", F.trim("l"))
    upper = (F.upper("l") == F.col("l")) & (F.lower("l") != F.col("l"))
    return lines.select("doc_id", "line_no", F.col("l").alias("line"), (T.one_line(F.col("l")) == "").alias("blank"), upper.alias("upper"),
        T.looks_like_heading(F.col("l")).alias("heading"), T.starts_article(F.col("l")).alias("article"))
