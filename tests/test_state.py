"""Machines, limits and merges: streams against tables, replays, readers during replacement."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.plans import state_queries as Q
from tessella.sources.versions import Conflict, VersionedTable
from tessella.streaming import conversation as C
from tessella.streaming import fanout, limits
from tessella.streaming import machine as M
from tessella.streaming import state as X


def step(state, message, role="member", version="v1", cards=True, **more):
    """One message through the rules, its facts made in plain Python."""
    m = C.conversation(cards=cards)
    word = message.strip().lower()
    marks, choice, target = next(((w[1], w[2], w[3]) for w in C.vocabulary() if w[0] == word), ([], None, None))
    number = int(word) if word.isdigit() else None
    if number is not None:
        marks = [*marks, "digits"]
        active = [t.ident for t in C.TOPICS if t.active]
        target = target or (active[number - 1] if 0 < number <= len(active) else None)
    topic = next((t for t in C.TOPICS if t.ident == target), None)
    facts = tuple(marks), choice, target, topic and topic.module, bool(topic and topic.needs_login), bool(topic and role in topic.barred), number, version
    now = m.start | state
    rule, reply, sides, after = M.Stepper(m).step(tuple(now[f] for f in m.fields), facts)
    return rule, reply, sides, dict(zip(m.fields, after))


IN = {"state": "carousel", "language": "fr", "consent": "accepted", "version": "v1"}

CASES = [
    ({}, "hello", "08c", {"state": "language"}), ({}, "fr", "08b", {"state": "consent", "language": "fr"}), ({"consent": "accepted"}, "es", "08a", {"state": "carousel", "language": "es"}),
    ({"state": "consent", "language": "fr"}, "accept", "09a", {"consent": "accepted", "state": "carousel", "version": "v1"}), ({"state": "consent", "language": "fr"}, "1", "09a", {"consent": "accepted"}),
    ({"state": "consent", "language": "fr"}, "2", "09b", {"consent": "refused", "state": "consent"}), ({"state": "consent", "language": "fr"}, "full", "09c", {"consent": "none"}),
    ({"state": "consent", "language": "fr"}, "what", "09d", {"state": "consent"}), ({"state": "consent"}, "accept", "08c", {"consent": "none"}),
    (IN, "stop", "03", {"state": "consent", "language": None, "consent": "none", "version": None}), (IN, "start", "06", {"state": "language", "language": None, "consent": "none"}),
    (IN, "support", "01a", IN), (IN | {"theme": "tides", "state": "search"}, "support site", "20", {"state": "search"}), (IN, "form", "02", IN),
    (IN | {"state": "main_menu"}, "back_to_themes", "04a", {"state": "carousel"}), ({"language": "fr", "state": "consent"}, "back_to_themes", "04b", {"state": "consent"}),
    (IN, "back_to_language", "04c", {"state": "language", "language": None, "consent": "accepted"}), (IN, "/language", "05", {"state": "language", "language": None}),
    (IN | {"language": None}, "help", "13b", {"language": "fr"}), (IN | {"version": "v0"}, "menu", "10", {"consent": "none", "state": "consent"}), (IN | {"version": None}, "menu", "12", {"consent": "accepted"}),
    (IN | {"theme": "old"}, "menu", "11", {"theme": None, "state": "main_menu"}), (IN | {"theme": "never"}, "menu", "11", {"theme": None}), (IN | {"state": "main_menu"}, "menu", "12", {"state": "carousel"}),
    (IN, "profile", "13a", IN), (IN | {"theme": "harbour", "state": "topic_menu"}, "3", "14", {"state": "topic_menu"}), (IN | {"state": "legacy_question"}, "back", "15a", {"state": "legacy_question"}),
    (IN | {"state": "legacy_data", "theme": "tides"}, "back", "15b", {"state": "carousel", "theme": None}), (IN | {"state": "free_question", "theme": "customs"}, "back", "15d", {"state": "topic_menu"}),
    (IN | {"state": "search", "theme": "tides"}, "back", "15e", {"state": "carousel", "theme": "tides"}), (IN | {"theme": "pilots", "state": "login"}, "auth ok", "16a", {"authenticated": True, "state": "topic_menu"}),
    (IN, "auth ok", "16b", {"authenticated": True, "state": "main_menu"}), (IN, "theme_pilots", "17pb", {"state": "login", "theme": "pilots"}), (IN | {"authenticated": True}, "theme_pilots", "17pf", {"state": "free_question"}),
    (IN, "theme_tides", "17pd_search", {"state": "search", "theme": "tides"}), (IN, "theme_charts", "17pe", {"state": "carousel", "theme": None}), (IN, "tide tables", "17td_search", {"theme": "tides"}),
    (IN | {"theme": "customs", "state": "document_question"}, "tide tables", "22", {"theme": "customs"}), (IN | {"state": "onboarding_role"}, "7", "180", {"state": "onboarding_city"}), (IN, "7", "19hb", {"state": "login", "theme": "pilots"}),
    (IN, "99", "19ha", {"state": "main_menu"}), (IN | {"theme": "harbour", "state": "topic_menu"}, "9", "19e", {"state": "topic_menu"}), (IN | {"theme": "pilots", "state": "login"}, "9", "19a", {"state": "login"}),
    (IN | {"theme": "cargo", "state": "interaction"}, "a and b", "20", {"state": "interaction"}), (IN | {"state": "legacy_compliance", "theme": "x"}, "x", "11", {"theme": None}),
    (IN | {"state": "legacy_compliance"}, "x", "21", {"state": "carousel"}), (IN, "x", "23", {"state": "carousel"}), (IN | {"state": "legacy_benefits"}, "x", "24", {"state": "carousel"}),
    (IN | {"state": "free_question", "theme": "customs"}, "x", "25a", {"state": "free_question"}), (IN | {"state": "login", "theme": "customs"}, "x", "25c", {"state": "topic_menu"}),
    (IN | {"state": "topic_menu", "theme": "customs"}, "x", "26a", {"state": "document_question"}), (IN | {"state": "topic_menu", "theme": "harbour"}, "x", "26c", {"state": "topic_menu"}), (IN | {"state": "main_menu"}, "x", "27", {"state": "carousel"}),
]


@pytest.mark.parametrize("state, message, rule, wanted", CASES)
def test_every_rule_decides_where_it_should(state, message, rule, wanted):
    told = step(state, message)
    assert told[0] == rule
    assert {k: told[3][k] for k in wanted} == wanted


def test_roles_cards_and_sides():
    assert step(IN, "theme_crew", role="guest")[:2] == ("17pc", "not for this role")
    assert step(IN, "theme_crew")[0] == "17pf"
    assert step(IN | {"state": "main_menu"}, "menu", cards=False)[3]["state"] == "main_menu"
    assert step(IN, "support site")[2] == ("support",) and step(IN, "stop")[2] == ("consent", "unsubscribe")
    assert step(IN | {"state": "topic_menu", "theme": "customs"}, "x")[2] == ("audit",)
    assert {r.name[:2] for r in C.conversation().rules} == {f"{k:02d}" for k in range(1, 28)}


def test_null_keys_and_messages_make_a_sequence(spark):
    e = spark.createDataFrame([(None, 1, "fr"), (None, 2, None), (7, 3, "accept")], "user_id long, event_id long, message string").withColumns({"role": F.lit(None).cast("string"), "told": F.lit("v1")})
    out = M.run_batch(C.with_facts(e, "message", "role", "told"), "user_id", ["event_id"], Q.MACHINE).orderBy("event_id").collect()
    assert [(r.rule, r.state) for r in out] == [("08b", "consent"), ("09d", "consent"), ("08c", "language")]
    assert M.run_batch(C.with_facts(e.where("false"), "message", "role", "told"), "user_id", ["event_id"], Q.MACHINE).count() == 0


def _batches(df, folder, by, n, rng):
    """Files of consecutive events, each shuffled, one for each micro-batch."""
    rows = sorted(df.collect(), key=lambda r: r[by])
    step = -(-len(rows) // n)
    for k in range(n):
        some = rows[k * step : (k + 1) * step]
        rng.shuffle(some)
        df.sparkSession.createDataFrame(some, df.schema).coalesce(1).write.mode("append").parquet(str(folder))


def _run(stream, folder, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_conversation_stream_equals_table(spark, sf, tmp_path):
    e = Q._messages(spark, sf).where("user_id < 6")
    _batches(e, tmp_path / "in", "event_id", 3, random.Random(2))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    names = ["user_id", "event_id", "rule", "reply", "sides", *Q.MACHINE.fields]
    have = sorted(map(str, _run(M.run_stream(stream, "user_id", ["event_id"], Q.MACHINE), tmp_path / "cp", "talk").select(*names).collect()))
    want = sorted(map(str, M.run_batch(e, "user_id", ["event_id"], Q.MACHINE).select(*names).collect()))
    assert have == want and len({r.split("rule='")[1][:3] for r in have}) > 12


def test_rate_limit_stream_equals_table_on_late_and_shuffled_events(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(k, rng.randrange(4), start + timedelta(seconds=rng.randrange(4000), microseconds=rng.randrange(10**6))) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    want = X.rate_limit(df, "user_id", "ts", ["event_id"], 60, 3)
    # events come up to 10 minutes late; the last one, of another key, moves the watermark past all
    late = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(500)))
    for k in range(6):
        spark.createDataFrame(late[k * 50 : k * 50 + 50], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for n in (1, 2):
        spark.createDataFrame([(10**6 + n, 99, start + timedelta(days=n))], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = limits.stream_rate_limit(stream, "user_id", "ts", ["event_id"], 60, 3, "20 minutes")
    have = _run(out, tmp_path / "cp", "limited").where("user_id <> 99")
    assert sorted(map(str, have.collect())) == sorted(map(str, want.select(*have.columns).collect()))
    assert 0 < have.where("not allowed").count() < 300


def test_opt_out_batches_are_merged_once(spark, tmp_path):
    target = VersionedTable(spark, str(tmp_path / "t"))
    target.replace({"preferences": spark.createDataFrame([(1, "a", "active"), (1, "b", "opted_out"), (2, "a", None), (3, "a", "active")], "k long, kind string, status string")})
    merge = fanout.opt_out_merge(target, "k", "at")
    stops = spark.createDataFrame([(1, datetime(2024, 1, 2)), (1, datetime(2024, 1, 1)), (None, datetime(2024, 1, 1)), (9, datetime(2024, 1, 1))], "k long, at timestamp")
    merge(stops, 0)
    merge(stops, 0)
    merge(spark.createDataFrame([(2, datetime(2024, 2, 1))], stops.schema), 1)
    merge(stops, 0)
    have = sorted(map(tuple, target.read("preferences").collect()))
    assert have == [(1, "a", "opted_out"), (1, "b", "opted_out"), (2, "a", "opted_out"), (3, "a", "active")]
    assert sorted(map(tuple, target.read("history").collect())) == [(1, "a", "opted_out", datetime(2024, 1, 1), 0), (2, "a", "opted_out", datetime(2024, 2, 1), 1)]
    assert target.version() == 3


def test_opt_out_stream(spark, tmp_path):
    target = VersionedTable(spark, str(tmp_path / "t"))
    target.replace({"preferences": spark.createDataFrame([(k, "active") for k in range(6)], "k long, status string")})
    for k in (1, 3):
        spark.createDataFrame([(k, datetime(2024, 1, k))], "k long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    X.stream_into_table(stream, fanout.opt_out_merge(target, "k", "at"), str(tmp_path / "cp"))
    assert {r.k for r in target.read("preferences").where("status = 'opted_out'").collect()} == {1, 3}
    assert target.read("history").count() == 2


def test_readers_never_find_a_gap_and_writers_are_told(spark, tmp_path):
    target = VersionedTable(spark, str(tmp_path / "t"))
    frame = lambda n: spark.range(n).toDF("x")
    target.replace({"rows": frame(1)}, note="first")
    seen, failed, done = [], [], threading.Event()

    def reader():
        while not done.is_set():
            try:
                seen.append(target.read().count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=reader)
    t.start()
    for n in range(2, 6):
        target.replace({"rows": frame(n)})
    done.set()
    t.join()
    assert not failed and set(seen) <= set(range(1, 6)) and seen == sorted(seen)
    with pytest.raises(Conflict):
        target.replace({"rows": frame(99)}, base=2)
    assert target.read().count() == 5 and target.facts(1)["facts"] == {"note": "first"}
    target.keep_last(2)
    assert target.read().count() == 5 and target._commits() == [4, 5]
