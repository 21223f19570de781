"""Filters, joins, aggregates and ranking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import relational as R
from tessella.operators import rules as P
from tessella.sources.readers import table

from .registry import query

NOW = "2024-01-02 12:00:00"


@query("pf01_pf02_equal_filters", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def equal_filters(spark, d):
    return R.where_equal(table(spark, d, "orders"), o_orderstatus="O", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_custkey", "o_totalprice")


@query("pf03_not_null_count", "SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL")
def not_null_count(spark, d):
    return table(spark, d, "documents").where(F.col("lang").isNotNull()).agg(F.count("*").alias("n"))


@query("pf04_not_expired", f"SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '{NOW}'")
def not_expired(spark, d):
    return R.not_expired(table(spark, d, "events"), "ts", NOW).select("event_id", "user_id")


@query("pf05_membership", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def membership(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("pf06_sc14_contains_and_days", """
SELECT event_id, event_type, ts FROM events
WHERE contains(lower(props), '"k": 6') AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-04'""")
def contains_and_days(spark, d):
    df = R.where_contains(table(spark, d, "events"), ["props"], '"K": 6')
    return R.where_days(df, "ts", "2024-01-01", "2024-01-03").select("event_id", "event_type", "ts")


@query("pf07_status_and_id_search", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND (contains(lower(c_name), '00001') OR contains(CAST(c_custkey AS VARCHAR), '77'))")
def status_and_id(spark, d):
    df = R.where_equal(table(spark, d, "customer"), c_mktsegment="BUILDING")
    return R.where_contains(df, ["c_name", "c_custkey"], "00001").unionByName(R.where_contains(df, ["c_custkey"], "77")).distinct().select("c_custkey", "c_name")


@query("pf08_pf09_dropped_and_coerced", """
SELECT o_orderkey, CASE WHEN lower(trim(o_orderstatus)) IN ('o', 'f') THEN lower(trim(o_orderstatus)) ELSE 'other' END AS status FROM orders""")
def dropped_and_coerced(spark, d):
    df = table(spark, d, "orders").drop("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return df.select("o_orderkey", T.one_of(F.col("o_orderstatus"), ["o", "f"], "other").alias("status"))


@query("pf10_row_validation", """
SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance=negative' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment=closed' END) AS errors
FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'""")
def row_validation(spark, d):
    e = R.errors_of({"balance": F.when(F.col("c_acctbal") < 0, "negative"), "segment": F.when(F.col("c_mktsegment") == "MACHINERY", "closed")})
    df = table(spark, d, "customer").select("c_custkey", e.alias("e")).where(F.size("e") > 0)
    return df.select("c_custkey", F.array_join(F.transform(F.map_entries("e"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("errors"))


@query("pf11_threshold_alert", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 0 THEN 'out' WHEN l_quantity <= 5 OR l_returnflag = 'R' THEN 'low' ELSE 'ok' END AS alert FROM lineitem""")
def threshold_alert(spark, d):
    df = table(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", R.threshold_alert(F.col("l_quantity"), F.lit(5), F.col("l_returnflag") == "R").alias("alert"))


@query("pf12_pf13_roles_and_consent", """
SELECT event_id, coalesce(value > 10 AND event_type IS NOT NULL AND event_type <> 'view', false) AS restricted, event_type = 'signup' OR user_id % 2 = 0 AS consented FROM events""")
def roles_and_consent(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", R.restricted(F.col("value") > 10, F.col("event_type"), "view").alias("restricted"), ((F.col("event_type") == "signup") | (F.col("user_id") % 2 == 0)).alias("consented"))


@query("pf14_page_selection", """
SELECT conv_id, turn FROM conversations c
WHERE conv_id % 3 <> 0 OR turn IN (0, 2)""")
def page_selection(spark, d):
    df = table(spark, d, "conversations")
    chosen = df.where(F.col("conv_id") % 3 == 0).select("conv_id").distinct().withColumn("_pages", F.array(F.lit(0).cast("long"), F.lit(2).cast("long")))
    return df.join(chosen, "conv_id", "left").where(F.col("_pages").isNull() | F.array_contains("_pages", F.col("turn"))).select("conv_id", "turn")


@query("pf15_template_key", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'closed_large' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'default' END AS template_key FROM orders""")
def template_key(spark, d):
    closed = F.col("o_orderstatus") == "F"
    key = F.when(closed & (F.col("o_totalprice") > 100000), "closed_large").when(closed, "closed").when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("default")
    return table(spark, d, "orders").select("o_orderkey", key.alias("template_key"))


@query("jn03_so01_tk01_lookup_feed", """
SELECT * FROM (
  SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS id, coalesce(c_name, 'unknown') AS title, o_orderdate AS happened
  FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30) o LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), event_type, ts FROM events WHERE event_type = 'signup') ORDER BY happened DESC, id""")
def lookup_feed(spark, d):
    orders = R.top_rows(table(spark, d, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 30).withColumnRenamed("o_custkey", "c_custkey")
    named = R.lookup(orders, table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", {"c_name": "unknown"})
    a = named.select(F.lit("order").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("o_orderdate").alias("happened"))
    b = table(spark, d, "events").where("event_type = 'signup'").select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.col("ts").alias("happened"))
    return R.feed([a, b], [F.desc("happened"), "id"])


_SENT = "SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus <> 'F'"
_OK = "SELECT c_custkey FROM customer WHERE c_acctbal > 0"


def _parties(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    sent = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c, sent, table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")


@query("jn04_jn05_jn06_eligible", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN ({_SENT}) AND c_custkey IN ({_OK})")
def eligible(spark, d):
    c, sent, ok = _parties(spark, d)
    return R.eligible(c, "c_custkey", sent, ok)


@query("ag07_skip_counters", f"""
SELECT CASE WHEN c_custkey IN ({_SENT}) THEN 'already_sent' WHEN c_custkey NOT IN ({_OK}) THEN 'no_consent' ELSE 'eligible' END AS class, count(*) AS n FROM customer GROUP BY 1""")
def skip_counters(spark, d):
    c, sent, ok = _parties(spark, d)
    return R.classify_candidates(c, "c_custkey", sent, ok).groupBy("class").agg(F.count("*").alias("n"))


@query("jn10_pf16_guarded_rows", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def guarded_rows(spark, d):
    ok = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    no = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").join(ok, "l_partkey", "left_semi").join(no, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("jn02_jn11_multi_lookup", """
SELECT c_custkey, n_name, r_name, coalesce(n_orders, 0) AS n_orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def multi_lookup(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    df = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(per, "c_custkey", "left")
    return df.select("c_custkey", "n_name", "r_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("jn13_sf27_canonical_key_join", """
SELECT a.c_custkey AS left_key, b.c_custkey AS right_key
FROM (SELECT c_custkey, '+212' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p FROM customer) a
JOIN (SELECT c_custkey, '+212' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p FROM customer WHERE c_acctbal > 5000) b ON a.p = b.p""")
def canonical_join(spark, d):
    c = table(spark, d, "customer")
    digits = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    a = c.select(F.col("c_custkey").alias("left_key"), T.phone_address(F.concat(F.lit("whatsapp:+212 "), digits)).alias("k"))
    b = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("right_key"), T.phone_address(F.concat(F.lit("00212-"), digits)).alias("k"))
    return a.join(b, "k").select("left_key", "right_key")


@query("jn14_sc10_override", """
SELECT p_partkey, coalesce(CASE WHEN p_size > 30 THEN p_type END, CASE WHEN p_size > 10 THEN p_brand END, p_name) AS label FROM part""")
def override(spark, d):
    p = table(spark, d, "part")
    base = p.select("p_partkey", F.col("p_name").alias("label"))
    return R.override(base, [p.where("p_size > 10").select("p_partkey", F.col("p_brand").alias("label")), p.where("p_size > 30").select("p_partkey", F.col("p_type").alias("label"))], "p_partkey", ["label"])


_RULES = [("steel", "brass", "red", 3, 0), ("copper", "tin", "orange", 2, 1), ("nickel", "steel", "green", 1, 2), ("tin", "tin", "red", 3, 3), ("brass", "copper", "green", 1, 4)]
_RULE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{lv}', {s}, {n})" for a, b, lv, s, n in _RULES) + ") r(first, second, level, severity, rule_no)"
_PAIRS_SQL = f"""
WITH items AS (SELECT l_orderkey, l_linenumber, lower(p_type) AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 4 = 0 OR true),
pairs AS (SELECT a.l_orderkey, a.l_linenumber AS place_a, b.l_linenumber AS place_b, a.name AS name_a, b.name AS name_b
          FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
hits AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, place_a, place_b ORDER BY severity DESC, rule_no) AS n FROM pairs JOIN {_RULE_SQL}
  ON ((name_a = first OR contains(name_a, first) AND length(first) >= 4 OR contains(first, name_a) AND length(name_a) >= 4)
      AND (name_b = second OR contains(name_b, second) AND length(second) >= 4 OR contains(second, name_b) AND length(name_b) >= 4))
  OR ((name_b = first OR contains(name_b, first) AND length(first) >= 4 OR contains(first, name_b) AND length(name_b) >= 4)
      AND (name_a = second OR contains(name_a, second) AND length(second) >= 4 OR contains(second, name_a) AND length(name_a) >= 4)))
"""


def _pairs(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("name"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")
    rules = spark.createDataFrame(_RULES, "first string, second string, level string, severity int, rule_no int")
    return P.pair_rules(items, rules, "l_orderkey", "l_linenumber", "name")


@query("jn08_pairwise_rules", _PAIRS_SQL + "SELECT l_orderkey, place_a, place_b, level, rule_no FROM hits WHERE n = 1")
def pairwise_rules(spark, d):
    return _pairs(spark, d).select("l_orderkey", "place_a", "place_b", "level", "rule_no")


@query("rt14_ag11_tk07_rule_report", _PAIRS_SQL + """SELECT l_orderkey, arg_max(level, severity) AS worst_level, count(*) FILTER (level = 'red') AS n_red,
 count(*) FILTER (level = 'orange') AS n_orange, count(*) FILTER (level = 'green') AS n_green FROM hits WHERE n = 1 GROUP BY 1""")
def rule_report(spark, d):
    return P.rule_report(_pairs(spark, d), "l_orderkey", ["red", "orange", "green"])


_MATCH_SQL = """
WITH q AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 5 = 0 THEN 'zzz' WHEN p_partkey % 3 = 0 THEN split_part(lower(p_name), ' ', 1) ELSE lower(p_name) END AS q FROM part),
items AS (SELECT min(p_partkey) AS item_id, lower(p_name) AS name, lower(p_brand) AS alias FROM part GROUP BY 2, 3),
toks AS (SELECT qid, unnest(list_distinct(string_split(q, ' '))) AS tok FROM q),
itoks AS (SELECT item_id, unnest(list_distinct(string_split(name, ' '))) AS tok FROM items),
scored AS (SELECT qid, item_id, count(*) AS s FROM toks JOIN itoks USING (tok) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS rank FROM scored),
top AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM ranked WHERE rank <= 5),
best AS (SELECT t.qid, t.item_id, n, CASE WHEN name = q THEN 0 WHEN alias = q THEN 1 ELSE 2 END AS prio,
   row_number() OVER (PARTITION BY t.qid ORDER BY CASE WHEN name = q THEN 0 WHEN alias = q THEN 1 ELSE 2 END, rank) AS r
   FROM top t JOIN q USING (qid) JOIN items USING (item_id)),
status AS (SELECT q.qid, item_id, CASE WHEN item_id IS NULL THEN 'rejected' WHEN prio < 2 OR n = 1 THEN 'validated' ELSE 'review' END AS match_status
  FROM q LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (qid))
"""


def _matches(spark, d):
    part = table(spark, d, "part")
    name = F.lower("p_name")
    q = part.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 5 == 0, "zzz").when(F.col("p_partkey") % 3 == 0, F.split_part(name, F.lit(" "), F.lit(1))).otherwise(name).alias("q"))
    items = part.groupBy(name.alias("name"), F.lower("p_brand").alias("alias")).agg(F.min("p_partkey").alias("item_id"))
    asked = q.where("q is not null").select("q").distinct()  # each text is matched once, with each name once
    firsts = R.top_by(items, ["name"], ["item_id"], 5, "_n").drop("_n")  # of one name no more can be among the best five
    a = asked.select("q", F.explode(F.array_distinct(F.split("q", " "))).alias("tok"))
    b = firsts.select("name").distinct().select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("tok"))
    s = a.join(b, "tok").groupBy("q", "name").agg(F.count("*").alias("s"))
    top = R.top_by(s.join(firsts, "name"), ["q"], [F.desc("s"), "item_id"], 5)
    n = top.groupBy("q").agg(F.count("*").alias("n_candidates"))
    found = P.match_status(asked.withColumn("text", F.col("q")), top.join(n, "q"), "q", "text")
    return q.join(found, "q", "left").select("qid", "item_id", F.coalesce("match_status", F.lit("rejected")).alias("match_status"))


@query("jn09_fuzzy_match", _MATCH_SQL + "SELECT qid, item_id, match_status FROM status")
def fuzzy_match(spark, d):
    return _matches(spark, d)


@query("ag08_file_status", _MATCH_SQL + """SELECT qid % 10 AS file, count(*) FILTER (match_status = 'validated') AS n_validated, count(*) FILTER (match_status = 'review') AS n_review,
 count(*) FILTER (match_status = 'rejected') AS n_rejected, CASE WHEN count(*) FILTER (match_status = 'review') > 0 THEN 'pending_review' ELSE 'processed' END AS file_status FROM status GROUP BY 1""")
def file_status(spark, d):
    return P.file_status(_matches(spark, d).withColumn("file", F.col("qid") % 10), "file")


# ---------------------------------------------------------------- aggregates


@query("ag01_conditional_counts", """
SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 20) AS large, count(*) FILTER (user_id IS NULL) AS anonymous, count(*) FILTER (event_type = 'error' AND value < 5) AS small_errors FROM events""")
def conditional_counts(spark, d):
    t = F.col("event_type")
    return R.counts(table(spark, d, "events"), {"clicks": t == "click", "large": F.col("value") > 20, "anonymous": F.col("user_id").isNull(), "small_errors": (t == "error") & (F.col("value") < 5)})


@query("ag02_count_by_category", "SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1")
def count_by(spark, d):
    return R.count_by(table(spark, d, "documents"), "source")


@query("ag02_fixed_buckets", """
SELECT b.event_type, count(event_id) AS n FROM (VALUES ('click'), ('view'), ('refund'), ('error')) b(event_type) LEFT JOIN events USING (event_type) GROUP BY 1""")
def fixed_buckets(spark, d):
    b = spark.createDataFrame([("click",), ("view",), ("refund",), ("error",)], "event_type string")
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return b.join(n, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("ag03_distinct_average_today", """
SELECT source, count(DISTINCT lang) AS langs, round(coalesce(avg(coalesce(n_chars, 0)), 0), 2) AS avg_chars, count(*) FILTER (doc_id % 7 = 0) AS today FROM documents GROUP BY 1""")
def distinct_average(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(
        F.count_distinct("lang").alias("langs"), F.round(F.avg(F.coalesce("n_chars", F.lit(0))), 2).alias("avg_chars"), F.count_if(F.col("doc_id") % 7 == 0).alias("today"))


@query("ag04_ag05_distinct_sorted", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1 ORDER BY 1")
def distinct_sorted(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users")).orderBy("event_type")


@query("ag12_inverted_index", """
SELECT lang, source, array_to_string(list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))), ',') AS docs FROM documents GROUP BY 1, 2""")
def inverted_index(spark, d):
    df = table(spark, d, "documents").select("lang", "source", F.col("doc_id").cast("string").alias("doc"))
    df = df.groupBy("lang", "source").agg(F.array_sort(F.collect_set("doc")).alias("docs"))
    return df.select("lang", "source", F.array_join("docs", ",").alias("docs"))


@query("ag13_sf28_duplicate_groups", """
SELECT key, array_to_string(list_sort(list(doc_id)), ',') AS ids, count(*) AS n, CASE WHEN count(DISTINCT n_chars) = 1 THEN 'high' ELSE 'medium' END AS confidence
FROM (SELECT sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS key, doc_id, n_chars FROM documents) GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    df = table(spark, d, "documents").select(F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("key"), "doc_id", "n_chars")
    g = R.duplicate_groups(df, "key", "doc_id", "n_chars")
    return g.select("key", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n", "confidence")


@query("ag15_keep_last", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1")
def keep_last(spark, d):
    return R.keep_last(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@query("ag16_so05_list_union", """
SELECT doc_id, array_to_string([source, lang] || CASE WHEN lang = 'en' THEN [] ELSE ['other'] END, ',') AS tags FROM documents""")
def list_union(spark, d):
    none = F.array().cast("array<string>")
    tags = T.distinct_texts(F.concat(F.array("source", "lang"), F.when(F.col("lang") == "en", none).otherwise(F.array(F.lit(" other"), F.col("source")))))
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, ",").alias("tags"))


@query("ag19_quality_flags", """
SELECT doc_id, CAST(greatest(0, least(100, round(quality * 60 + (1 - toxic) * 45))) AS INTEGER) AS score, greatest(0, least(100, round(quality * 60 + (1 - toxic) * 45))) < 50 AS flagged FROM labels""")
def quality_flags(spark, d):
    df = table(spark, d, "labels").select("doc_id", (F.col("quality") * 60).alias("a"), ((1 - F.col("toxic")) * 45).alias("b"))
    return df.withColumns(R.total_score(["a", "b"])).select("doc_id", "score", "flagged")


@query("ag20_mean_per_page", "SELECT l_orderkey, round(avg(l_discount), 6) AS confidence FROM lineitem GROUP BY 1")
def mean_per_page(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_discount"), 6).alias("confidence"))


# ---------------------------------------------------------------- ranking and sets


@query("tk01_tk08_newest_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def newest_page(spark, d):
    return R.top_rows(table(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), "event_id"], 20, 40)


@query("tk02_tk03_multi_key_sort", "SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7 ORDER BY c_mktsegment <> 'BUILDING', c_acctbal DESC, c_custkey LIMIT 12")
def multi_key_sort(spark, d):
    return R.top_rows(table(spark, d, "customer").where("c_nationkey = 7"), [F.col("c_mktsegment") != "BUILDING", F.desc("c_acctbal"), "c_custkey"], 12).select("c_custkey", "c_acctbal")


@query("tk04_wn03_top_per_bucket", "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 4")
def top_per_bucket(spark, d):
    return R.top_by(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), "event_id"], 4).select("user_id", "event_id", "rank")


@query("tk06_wn07_arg_max", "SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS best_line FROM lineitem GROUP BY 1 HAVING max(l_extendedprice) > 0")
def arg_max(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("best_line"), F.max("l_extendedprice").alias("m"))
    return g.where("m > 0").select("l_orderkey", "best_line")


@query("wn04_batch_numbers", "SELECT c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 50) AS INTEGER) + 1 AS batch_number FROM customer")
def batch_numbers(spark, d):
    return R.batch_numbers(table(spark, d, "customer"), ["c_nationkey"], ["c_custkey"], 50).select("c_custkey", "batch_number")


@query("wn05_numbered_ids", "SELECT l_orderkey, l_linenumber, printf('%s__chunk_%03d', CAST(l_orderkey AS VARCHAR), row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)) AS chunk_id FROM lineitem")
def numbered_ids(spark, d):
    return R.numbered_ids(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber"]).select("l_orderkey", "l_linenumber", "chunk_id")


@query("wn06_carry_forward", """
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS last_click, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def carry_forward(spark, d):
    click = F.col("event_type") == "click"
    df = R.carry_forward(table(spark, d, "events"), ["user_id"], ["event_id"], click, F.col("value"), "last_click")
    return R.segments(df, ["user_id"], ["event_id"], click).select("event_id", "last_click", "segment")


@query("wn09_look_back", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def look_back(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))


@query("sf26_unique_ids", """
SELECT p_partkey, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS unique_id
FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) - 1 AS n FROM (SELECT p_partkey, regexp_replace(lower(p_brand), '[^0-9a-z]+', '-', 'g') AS slug FROM part))""")
def unique_ids(spark, d):
    df = table(spark, d, "part").select("p_partkey", T.slug(F.col("p_brand")).alias("slug"))
    return R.unique_slugs(df, "slug", ["p_partkey"]).select("p_partkey", "unique_id")


@query("tk10_budget_prefix", """
WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
walk(conv_id, i, used, context) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM t
  UNION ALL
  SELECT w.conv_id, t.i, CASE WHEN used + length(text) <= 900 THEN used + length(text) + 2 ELSE used END,
         CASE WHEN used + length(text) <= 900 THEN concat_ws(chr(10) || chr(10), context, text) ELSE context END
  FROM walk w JOIN t ON t.conv_id = w.conv_id AND t.i = w.i + 1)
SELECT conv_id, arg_max(coalesce(context, ''), i) AS context FROM walk GROUP BY 1""")
def budget_prefix(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", F.array_join(R.fit_budget(F.transform("t", lambda x: x["text"]), 900), "\n\n").alias("context"))


@query("so02_sc04_first_source_wins", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS v FROM (SELECT c_custkey AS k, 'customer' AS v FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT s_suppkey AS k, 'supplier' AS v FROM supplier) b ON a.k = b.k")
def first_source(spark, d):
    a = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("v"))
    return R.first_source([a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("v"))], "k")


@query("so03_set_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference(spark, d):
    from tessella.operators.mutations import orphans

    return orphans(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("so04_shared_tokens", """
SELECT a.p_partkey, len(list_intersect(list_distinct(string_split(lower(a.p_name), ' ')), list_distinct(string_split(lower(b.p_name), ' ')))) AS shared
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def shared_tokens(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("t"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("t").alias("u"))
    return p.join(b, "p_partkey").select("p_partkey", R.shared_tokens("t", "u").cast("long").alias("shared"))
