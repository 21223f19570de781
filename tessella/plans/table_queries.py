"""Table maintenance and event state over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import mutations as M
from tessella.operators import relational as R
from tessella.session import shared_dir
from tessella.sources import readers, sinks
from tessella.sources.audit import Audit
from tessella.sources.readers import table
from tessella.streaming import state as S

from .registry import query


@query("sk03_replace_groups", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT o_orderkey, 1, 0.0 FROM orders WHERE o_orderstatus = 'O'""")
def replace_groups(spark, d):
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity"))
    return M.replace_groups(old, new, "l_orderkey")


@query("sk04_sk05_upsert", """
SELECT c_custkey, coalesce(n, c_name) AS c_name, coalesce(b, c_acctbal) AS c_acctbal FROM customer
FULL JOIN (SELECT o_custkey, arg_max('order ' || o_orderkey, o_orderkey) AS n, arg_max(o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("c_name"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    return M.upsert(c, o, ["c_custkey"], ["o_orderkey"])


@query("sk06_find_or_create", """
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(v, c_mktsegment) AS c_mktsegment, CASE WHEN c_custkey IS NULL THEN 'created' WHEN v IS NOT NULL AND v IS DISTINCT FROM c_mktsegment THEN 'updated' ELSE 'kept' END AS action
FROM customer FULL JOIN (SELECT c_custkey * 2 AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer) ON k = c_custkey""")
def find_or_create(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    seen = c.select((F.col("c_custkey") * 2).alias("c_custkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return M.find_or_create(c, seen, "c_custkey", ["c_mktsegment"])


@query("sk07_st03_append_new", """
SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0""")
def append_new(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    batch = e.where("event_id % 3 = 0")
    return M.append_new(e.where("event_id % 2 = 0"), batch.union(batch), ["event_id"])


@query("sk08_patch", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 4 = 0 THEN 'a=2;b=' || o_orderpriority || ';c=1' ELSE 'a=1;b=' || o_orderpriority END AS meta FROM orders""")
def patch(spark, d):
    o = table(spark, d, "orders")
    base = o.select("o_orderkey", "o_orderstatus", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("o_orderpriority")).alias("meta"))
    p = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("1")).alias("meta"))
    out = M.patch(base, p, "o_orderkey", ["o_orderstatus"], "meta")
    pairs = F.array_sort(F.transform(F.map_entries("meta"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return out.select("o_orderkey", "o_orderstatus", F.array_join(pairs, ";").alias("meta"))


_STATE = """
WITH cur AS (SELECT DISTINCT o_custkey AS c, CASE WHEN o_custkey % 5 = 0 THEN 'revoked' ELSE 'active' END AS s FROM orders WHERE o_orderstatus = 'F'),
want AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'O'),
diff AS (SELECT coalesce(cur.c, want.c) AS c, CASE WHEN want.c IS NOT NULL AND s = 'active' THEN 'keep' WHEN want.c IS NOT NULL THEN 'activate' WHEN s = 'active' THEN 'revoke' ELSE 'none' END AS action,
  CASE WHEN want.c IS NOT NULL THEN 'active' ELSE 'revoked' END AS status FROM cur FULL JOIN want ON cur.c = want.c)
"""


def _diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), "o_orderstatus")
    cur = o.where("o_orderstatus = 'F'").select("c", F.when(F.col("c") % 5 == 0, "revoked").otherwise("active").alias("status")).distinct()
    return M.desired_state(cur, o.where("o_orderstatus = 'O'").select("c"), ["c"])


@query("sk09_desired_state", _STATE + "SELECT * FROM diff")
def desired_state(spark, d):
    return _diff(spark, d)


@query("sk09_history_rows", _STATE + "SELECT c, action, status, TIMESTAMP '2024-01-01' AS changed_at FROM diff WHERE action IN ('activate', 'revoke')")
def history_rows(spark, d):
    return M.history_rows(_diff(spark, d), ["c"], "2024-01-01 00:00:00")


@query("sk10_cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return M.delete_where_in(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey")


@query("sk11_newest_ring", "SELECT user_id, event_id FROM (SELECT user_id, event_id FROM (SELECT user_id, arg_max(event_id, event_id) AS event_id FROM events GROUP BY 1) ORDER BY event_id DESC, user_id LIMIT 20)")
def newest_ring(spark, d):
    return M.newest_ring(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


@query("sk13_csv_lines", """SELECT CAST(c_custkey AS VARCHAR) || ',"' || replace(c_name, '"', '""') || '",' || c_mktsegment AS line FROM customer""")
def csv_lines(spark, d):
    return sinks.csv_lines(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_name"])


@query("sk15_markdown_report", """
SELECT conv_id, '# ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS report FROM conversations GROUP BY 1""")
def markdown_report(spark, d):
    return sinks.markdown_report(table(spark, d, "conversations"), "conv_id", ["turn"], "role", "text")


@query("sk04_key_violations", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def key_violations(spark, d):
    return M.key_violations(table(spark, d, "orders"), ["o_custkey"])


# ---------------------------------------------------------------- sources


@query("sc05_ag18_text_pages", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, 1 AS page_number, text FROM documents")
def text_pages(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_name"), "text")
    return readers.text_pages(files).select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", "p.text")


@query("sc11_sc12_sc13_delimited_rows", """
SELECT row_number() OVER (ORDER BY n_nationkey) AS row_number, n_name || '|' || n_regionkey AS cells, n_name AS key FROM nation""")
def delimited_rows(spark, d):
    """An uploaded list of products: a header line, then `name;code` lines."""
    lines = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.concat(F.lit(" "), F.col("n_name"), F.lit("; "), F.col("n_regionkey").cast("string")).alias("value"))
    out = readers.parse_delimited(lines.union(spark.createDataFrame([(-1, "Product name;Code")], "n int, value string")))
    return out.select("row_number", F.array_join("cells", "|").alias("cells"), "key")


@query("sc08_layout_pages", """
SELECT conv_id AS doc_id, CAST(1 AS BIGINT) AS page_number, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text,
 string_agg(role || ' | ' || turn, chr(10) ORDER BY turn) AS tables FROM conversations GROUP BY 1""")
def layout_pages(spark, d):
    c = table(spark, d, "conversations").withColumnsRenamed({"conv_id": "doc_id"}).withColumn("page_number", F.lit(1).cast("long"))
    cells = c.select("doc_id", "page_number", F.lit(0).alias("table_no"), F.col("turn").alias("row_no"), F.lit(0).alias("col_no"), F.col("role").alias("text")).union(
        c.select("doc_id", "page_number", F.lit(0), F.col("turn"), F.lit(1), F.col("turn").cast("string")))
    return readers.layout_pages(c.select("doc_id", "page_number", F.col("turn").alias("pos"), "text"), cells)


@query("sc09_manual_sections", "SELECT p_partkey AS doc_id, unnest([1, 2]) AS page_number, unnest([p_name || chr(10) || p_brand, p_type || chr(10) || p_brand]) AS text FROM part")
def manual_sections(spark, d):
    sec = lambda t: F.struct(F.col(t).alias("title"), F.col("p_brand").alias("content"))
    return readers.manual_sections(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.array(sec("p_name"), sec("p_type")).alias("sections")))


@query("sc16_sc17_aliases", "SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, c_name) AS name FROM customer")
def aliases(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("nom"), F.col("c_name").alias("label"))
    return readers.aliased(c, {"id": ["id", "c_custkey"], "name": ["nom", "denomination", "label"]})


@query("sc19_translated", "SELECT DISTINCT event_type AS key, CASE event_type WHEN 'click' THEN 'Clic' WHEN 'view' THEN 'View' ELSE event_type END AS text FROM events")
def translated(spark, d):
    keys = table(spark, d, "events").select(F.col("event_type").alias("key")).distinct()
    return readers.translated(keys, {"en": {"view": "View"}, "fr": {"click": "Clic", "view": "Vue"}}, "en")


@query("sc18_sf51_form_events", "SELECT event_id, 'whatsapp:+212' || user_id AS phone, event_type || ' now' AS message FROM events")
def form_events(spark, d):
    e = table(spark, d, "events")
    body = F.concat(F.lit("From=whatsapp%3A%2B212"), F.col("user_id").cast("string"), F.lit("&Body="), F.col("event_type"), F.lit("+now"))
    return readers.form_events(e.select("event_id", body.alias("b")), "b").select("event_id", "phone", "message")


@query("sf50_sf59_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", readers.flatten_json(F.col("props"))["k"].cast("int").alias("k"))


# ---------------------------------------------------------------- event state


def _fold_sql(rules, words, start):
    """The last state of each user, event by event: the first rule that fits decides."""
    def fits(word, where):
        return " AND ".join([f"control = '{word}'"] * (word != "*") + [f"state = '{where}'"] * (where != "*")) or "true"

    cases = " ".join(f"WHEN {fits(word, where)} THEN " + ("state" if then == "=" else f"'{then}'") for word, where, then in rules)
    return f"""
WITH RECURSIVE e AS (SELECT user_id, {list(words)}[CAST(event_id % {len(words)} + 1 AS INTEGER)] AS control, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
walk(user_id, i, state) AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT), '{start}' FROM e
  UNION ALL
  SELECT w.user_id, e.i, CASE {cases} ELSE state END FROM walk w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.i = w.i + 1)
SELECT user_id, arg_max(state, i) AS state, max(i) AS n_events FROM walk GROUP BY 1"""


_TALK = ("start", "fr", "accept", "theme", "ask", "menu", "back", "stop", "hello")
_ANSWERS = ("accept", "refuse", "revoke", "reprompt", "other")


@query("st01_st02_state_machine", _fold_sql(S.CONVERSATION, _TALK, "awaiting_language"))
def state_machine(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in _TALK]), (F.col("event_id") % len(_TALK) + 1).cast("int"))
    return S.batch_states(table(spark, d, "events").withColumn("control", word), "user_id", ["event_id"], "control", S.CONVERSATION, "awaiting_language")


@query("st04_status_last_write", """
SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'failed' ELSE 'sent' END, event_id) AS status FROM events GROUP BY 1""")
def status_last_write(spark, d):
    e = table(spark, d, "events").withColumn("r", F.when(F.col("event_type") == "purchase", "delivered").when(F.col("event_type") == "error", "failed").otherwise("queued"))
    return S.last_status(e, "user_id", ["event_id"], "r")


@query("st04_status_monotonic", """
SELECT user_id, coalesce(arg_max(CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'failed' END, event_id) FILTER (event_type IN ('purchase', 'error')), 'sent') AS status FROM events GROUP BY 1""")
def status_monotonic(spark, d):
    e = table(spark, d, "events").withColumn("r", F.when(F.col("event_type") == "purchase", "delivered").when(F.col("event_type") == "error", "failed").otherwise("queued"))
    return S.last_status(e, "user_id", ["event_id"], "r", monotonic=True)


@query("st05_ag21_rate_limit", """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT user_id, event_id, i, ts AS window_start, 1 AS window_count FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts - w.window_start > INTERVAL 3600 SECOND THEN e.ts ELSE w.window_start END,
         CASE WHEN e.ts - w.window_start > INTERVAL 3600 SECOND THEN 1 ELSE w.window_count + 1 END
  FROM walk w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id, window_start, window_count, window_count <= 3 AS allowed FROM walk""")
def rate_limit(spark, d):
    return S.rate_limit(table(spark, d, "events"), "user_id", "ts", ["event_id"], 3600, 3)


@query("st06_jn12_consent_gate", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def consent_gate(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("consent_status"))
    return S.gate(table(spark, d, "events"), c, "user_id", ["BUILDING", "MACHINERY"]).select("event_id", "user_id")


@query("st07_opt_out", """
SELECT c_custkey, c_nationkey, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'opted_out' ELSE 'active' END AS status FROM customer""")
def opt_out(spark, d):
    prefs = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit("active").alias("status"))
    stops = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return S.opt_out(prefs, stops, "c_custkey", "2024-01-01 00:00:00")[0]


@query("st08_consent_lifecycle", _fold_sql(S.CONSENT, _ANSWERS, "pending"))
def consent_lifecycle(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in _ANSWERS]), (F.col("event_id") % len(_ANSWERS) + 1).cast("int"))
    return S.batch_states(table(spark, d, "events").withColumn("control", word), "user_id", ["event_id"], "control", S.CONSENT, "pending")


@query("st01_wn06_turn_state", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS state FROM conversations""")
def turn_state(spark, d):
    c = table(spark, d, "conversations")
    return S.turn_states(c, "conv_id", "turn", F.col("role") == "user", F.length("text").cast("long")).select("conv_id", "turn", "state")


@query("sf57_freshness", "SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-01-03') < 86400 AS fresh FROM events")
def freshness(spark, d):
    return table(spark, d, "events").select("event_id", T.is_fresh(F.col("ts"), F.lit("2024-01-03 00:00:00").cast("timestamp"), 86400).alias("fresh"))


@query("st09_st10_audited_steps", """
SELECT step, 'success' AS status, 1 AS attempt, CAST(n AS DOUBLE) AS n_rows, CAST(total AS DOUBLE) AS total FROM (
 SELECT 'orders' AS step, count(*) AS n, sum(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS total FROM orders
 UNION ALL SELECT 'late_lines', count(*), sum(l_linenumber) FROM lineitem WHERE l_quantity > 25
 UNION ALL SELECT 'documents', count(*), sum(length(coalesce(text, ''))) FROM documents)""")
def audited_steps(spark, d):
    """Three steps that write whole tables, and what the audit table says of them (times left out)."""
    run = uuid.uuid4().hex
    audit = Audit(spark, f"{shared_dir(spark)}/audit-{run}", run)

    def save(name):
        return lambda df: df.write.parquet(f"{shared_dir(spark)}/audited-{run}-{name}")

    steps = {
        "orders": (table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 100).cast("long").alias("cents")), F.sum("cents")),
        "late_lines": (table(spark, d, "lineitem").where("l_quantity > 25").select("l_orderkey", "l_linenumber"), F.sum("l_linenumber")),
        "documents": (table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")), F.sum("n")),
    }
    for name, (df, total) in steps.items():
        audit.step(name, df, save(name), total.alias("total"), attempts=3)
    return audit.rows().select("step", "status", "attempt", F.col("metrics")["rows"].alias("n_rows"), F.col("metrics")["total"].alias("total"))
