from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.functions.vectors import cosine
from tessella.operators import chunking as C
from tessella.operators import mutations as M
from tessella.operators import quality as Q
from tessella.operators import relational as R
from tessella.operators import retrieval as S
from tessella.operators import rules as P
from tessella.sources import readers, sinks
from tessella.streaming import state as X


# ---------------------------------------------------------------- chunking


def test_paragraph_packing_respects_the_budget(spark):
    parts = ["a" * 500, "b" * 598, "c" * 2000, "d", "", "e" * 5]
    df = spark.createDataFrame([(1, "\n\n".join(parts)), (2, ""), (3, None)], "i int, t string")
    out = C.paragraph_chunks(df, "i", "t").orderBy("chunk_no").collect()
    assert [r.chunk for r in out] == ["a" * 500 + "\n\n" + "b" * 598, "c" * 2000, "d\n\n" + "e" * 5]


PAGED = "i int, title string, pages array<struct<page_number:int,text:string>>"


def units_of(spark, pages, target=320):
    df = spark.createDataFrame([(1, "Doc", pages and list(enumerate(pages, 1)))], PAGED)
    return [(r.section, r.text, r.page_start, r.page_end) for r in C.section_units(df, "i", "title", "pages", target).orderBy("unit").collect()]


def test_long_units_end_with_a_page(spark):
    many = "word " * 210
    assert [u[2:] for u in units_of(spark, [many, many, "tail", "HEAD\n\nend"], 120)] == [(1, 2), (3, 3), (4, 4)]
    assert [u[2:] for u in units_of(spark, [many, "", "tail"], 120)] == [(1, 1), (3, 3)]  # a page without text ends it too
    assert units_of(spark, None) == [] and units_of(spark, [None, " "]) == []


def test_split_section_at_sentences(spark):
    text = "\n\n".join(["aa " * 100 + ".", "bb cc. " * 90, "dd " * 30])
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "")], "i int, t string")
    out = dict(df.select("i", C.split_section(F.col("t"), 120, 5)).collect())
    assert out[2] == ["short"] and out[3] == [""]
    assert [len(x.split()) for x in out[1]] == [101, 125, 95] and out[1][1].startswith("aa aa aa aa .\n\nbb cc.")


def test_section_units(spark):
    units = units_of(spark, ["INTRO\n\nfirst text\n\nArticle 1 : a\n\nmore\n\nArticle 2 : b", "tail"])
    assert units == [("INTRO", "first text", 1, 1), ("INTRO > Article 1 : a", "Article 1 : a\n\nmore", 1, 1), ("INTRO > Article 1 : a > Article 2 : b", "Article 2 : b\n\ntail", 1, 2)]


def test_long_sections_split_with_overlap(spark):
    paragraph = "one two three four five six seven eight nine ten. " * 4
    text = "\n\n".join([paragraph.strip()] * 30)
    df = spark.createDataFrame([(1, "T", [(1, text)])], "i int, title string, pages array<struct<page_number:int,text:string>>")
    out = C.section_chunks(df, "i", "title", "pages", target=70).collect()  # at least 120 words
    assert len(out) > 5 and all(r.content and r.word_count <= 1.4 * 120 for r in out)
    for a, b in zip(out, out[1:]):
        assert b.content.startswith(" ".join(a.content.split()[-40:]))
    assert [r.chunk_id for r in out][:2] == ["1__chunk_001", "1__chunk_002"]


def test_structure_chunks(spark):
    text = "TITRE I Objet\nArticle 1 : début\nligne\nCHAPITRE II Suite\nArticle 2 - " + "mot " * 500 + "\n1. point\n" + "mot " * 100 + "\nالمادة ٣ نص"
    df = spark.createDataFrame([("d", [(1, text)]), ("e", [(1, "no article"), (2, "")])], "i string, pages array<struct<page_number:int,text:string>>")
    out = C.structure_chunks(df, "i", "pages").collect()
    d = [r for r in out if r.i == "d"]
    assert [r.article_number for r in d][:2] == [None, "1"] and d[-1].article_number == "3"
    assert d[1].structure_path == "I Objet > II Suite"  # the heading before the next article counts for this one
    assert {r.chunk_type for r in d if r.article_number == "2"} == {"article_part"}
    assert [(r.chunk_type, r.content) for r in out if r.i == "e"] == [("preamble", "no article")]
    levels = {(r.level, r.label) for r in C.outline(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t").collect()}
    assert levels == {("title", "I Objet"), ("chapter", "II Suite"), ("article", "1"), ("article", "2"), ("article", "3")}


# ---------------------------------------------------------------- quality


def test_document_quality(spark):
    good = "This is a clean page with many readable words in it and nothing odd at all, for sure. " * 4
    noise = "@@@@ ~~~~ ^^ |||| ### a"
    df = spark.createDataFrame([(1, good), (1, good), (2, noise), (2, ""), (2, noise)], "doc int, text string")
    out = {r.doc: r for r in Q.document_quality(df, "doc").collect()}
    assert not out[1].is_low and out[1].score < 0.55
    assert out[2].is_low and out[2].score >= 0.55
    assert out[1].average_confidence == 0.75
    none = Q.document_quality(df.where("doc = 1"), "doc", documents=spark.createDataFrame([(1,), (7,)], "doc int"))
    assert {r.doc: (r.score, r.n_reasons, r.is_low) for r in none.collect()}[7] == (1.0, 1, True)


def test_page_metrics_equal_a_plain_count(spark):
    import re
    import unicodedata

    texts = ["Don't stop-word n° 5 == ## @x ~~~~ <b> ¦ © aaaa\n\n\n\n", None, "", "٣ نص المادة الأولى! �□■ \u200b\u00a0 a1 b\\c", "!!!!! tab\tx\x1cy 12 3 l’eau"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = {r.i: r for r in Q.page_metrics(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        seen = [c for c in t if not c.isspace()]
        fine = [c for c in seen if c.isalnum() or c in ".,;:!?()[]{}%/+-'’\"«»" or "\u0600" <= c <= "\u06FF"]
        odd = [c for c in seen if c not in fine and (c in Q.NOISE or unicodedata.category(c)[0] == "C")]
        runs = sum(len(m[0]) for m in re.finditer(r"(.)\1{3,}", t))
        want = (len(seen), len(fine), len(odd), len(t.split()), len(re.findall(Q.WORD, t)), runs, len(t.strip()))
        r = rows[i]
        assert (r.visible, r.readable, r.abnormal, r.n_tokens, r.n_words, r.repeated, r.n_chars) == want, t


def test_unique_slugs_count_up_to_a_free_one(spark):
    slugs = ["a", "a", "a-1", "a", "b-2", "b-2", "a-1", "a-1-1", None, "a", "c", "a-01"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(slugs)], "i int, slug string")
    taken, want = set(), {}
    for i, s in enumerate(slugs):
        k = 0
        while s is not None and (name := f"{s}-{k}" if k else s) in taken:
            k += 1
        want[i] = None if s is None else name
        taken.add(want[i])
    assert {r.i: r.unique_id for r in R.unique_slugs(df, "slug", ["i"]).collect()} == want


# ---------------------------------------------------------------- rules and matching


def test_pair_rules(spark):
    items = spark.createDataFrame([(1, 0, "warfarin"), (1, 1, "aspirin 100"), (1, 2, "tea"), (2, 0, "abc"), (2, 1, "warfarin sodium")], "l int, p int, n string")
    rules = spark.createDataFrame([("aspirin", "warfarin", "red", 3, 0), ("warfarin", "aspirin", "green", 1, 1), ("abcde", "warfarin", "red", 3, 2)], "first string, second string, level string, severity int, rule_no int")
    out = P.pair_rules(items, rules, "l", "p", "n").collect()
    assert [(r.l, r.place_a, r.place_b, r.level, r.rule_no) for r in out] == [(1, 0, 1, "red", 0)]  # three letters inside a name don't count
    report = P.rule_report(P.pair_rules(items, rules, "l", "p", "n"), "l", ["red", "green"]).collect()
    assert [(r.worst_level, r.n_red, r.n_green) for r in report] == [("red", 1, 0)]


# ---------------------------------------------------------------- search


def test_rank_one_on_tiny_corpora(spark):
    docs = spark.createDataFrame([("a", "storage of narcotics needs a locked cabinet"), ("b", "annual leave of staff"), ("c", "")], "i string, t string")
    qs = spark.createDataFrame([(1, "Locked cabinet?"), (2, "leave"), (3, "zzz")], "q int, t string")
    out = S.hybrid(docs, qs, "i", "t", "q", "t", 4).where("rank = 1").collect()
    assert {r.q: r.doc for r in out} == {1: "a", 2: "b"}


def test_bm25_grows_with_the_term_count(spark):
    docs = spark.createDataFrame([(k, "word " * k + "x " * (10 - k)) for k in range(1, 9)], "i int, t string")
    out = S.bm25(docs, spark.createDataFrame([(1, "word")], "q int, t string"), "i", "t", "q", "t").orderBy("doc").collect()
    assert [r.score for r in out] == sorted(r.score for r in out)


def test_rrf_is_symmetric_and_knows_both_missing_rules(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q int, d string, rank int")
    one = {r.d: r.fused for r in S.rrf(a, b, "q", "d").collect()}
    two = {r.d: r.fused for r in S.rrf(b, a, "q", "d").collect()}
    assert one == two and one["x"] == pytest.approx(1 / 61)
    assert {r.d: r.fused for r in S.rrf(a, b, "q", "d", 1000).collect()}["x"] == pytest.approx(1 / 61 + 1 / 1060)


def test_references_and_budget(spark):
    df = spark.createDataFrame([("see [R1] and [R9] [R2]", ["A", "B"], ["aaaa", "bbbbbbbb", "cc"])], "t string, l array<string>, b array<string>")
    row = df.select(S.replace_references(F.col("t"), F.col("l")).alias("t"), R.fit_budget(F.col("b"), 8).alias("b")).first()
    assert row.t == "see [A] and [R9] [B]" and row.b == ["aaaa", "cc"]


def test_exact_boost(spark):
    df = spark.createDataFrame([("Loi 17-04 art", "Loi 17-04", "5", ["5"], ["loi 17 04"], "que dit loi 17 04")], "c string, l string, a string, arts array<string>, docs array<string>, q string")
    boost = S.exact_boost({"corpus": F.col("c"), "label": F.col("l"), "article": F.col("a")}, {"articles": F.col("arts"), "documents": F.col("docs"), "dates": F.array().cast("array<string>"), "text": F.col("q")})
    assert df.select(boost.alias("b")).first().b == 24


# ---------------------------------------------------------------- mutations


def test_mutations_repeat_without_change(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    for f in (lambda t: M.replace_groups(t, new.distinct(), "k"), lambda t: M.upsert(t, new, ["k"]), lambda t: M.append_new(t, new, ["k"])):
        once = f(old)
        assert sorted(once.collect()) == sorted(f(once).collect())
    assert sorted(map(tuple, M.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    null = spark.createDataFrame([(None, "x"), (None, "y")], "k int, v string")
    assert M.append_new(old, null, ["k"]).count() == 4


def test_desired_state(spark):
    cur = spark.createDataFrame([(1, "active"), (2, "active"), (3, "revoked"), (4, "revoked")], "k int, status string")
    out = M.desired_state(cur, spark.createDataFrame([(1,), (3,), (5,)], "k int"), ["k"])
    assert {r.k: (r.action, r.status) for r in out.collect()} == {1: ("keep", "active"), 2: ("revoke", "revoked"), 3: ("activate", "active"), 4: ("none", "revoked"), 5: ("activate", "active")}
    assert M.history_rows(out, ["k"], "2024-01-01").count() == 3


# ---------------------------------------------------------------- sources and sinks


def test_json_collections(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"chunk_id": "1", "clean_text": "x"}]')
    (tmp_path / "b.json").write_text('{"doc_id": "top", "chunks": [{"chunk_id": "2", "topics": ["t"]}, {"chunk_id": "3"}]}')
    (tmp_path / "c.json").write_text('{"chunks": [{"chunk_id":')
    (tmp_path / "d.json").write_text('{"chunks": []}')
    out = readers.chunk_files(spark, str(tmp_path)).orderBy("file_name", "pos").collect()
    assert [(r.chunk_id, r.doc_id) for r in out] == [("1", None), ("2", None), ("3", None)]
    assert readers.json_collection(spark, str(tmp_path / "none.json"), readers.CHUNK_SCHEMA).count() == 0
    assert readers.chunk_index(spark, str(tmp_path / "index"), str(tmp_path)).count() == 3


def test_text_files_first_folder_wins(spark, tmp_path):
    for d, n, t in (("one", "a.md", "1"), ("two", "a.md", "2"), ("two", "b.md", "3"), ("two", "c.txt", "4")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / n).write_text(t)
    out = readers.text_files(spark, [str(tmp_path / "one"), str(tmp_path / "two")], r"\.md$").collect()
    assert {(r.file_name, r.text) for r in out} == {("a.md", "1"), ("b.md", "3")}
    assert readers.text_pages(readers.text_files(spark, [str(tmp_path / "one")])).first().pages[0].text == "1"


@pytest.mark.parametrize(("text", "want"), [
    ("Nom;Code\nA;1\n;2\n\n", [["A", "1"], ["", "2"]]), ("A,1\r\nB,2", [["A", "1"], ["B", "2"]]), ("A\tb;c\t1", [["A", "b;c", "1"]]), ("A;b,c", [["A", "b,c"]]), ("", []),
])
def test_delimited(spark, tmp_path, text, want):
    (tmp_path / "x.txt").write_text(text)
    out = readers.delimited_rows(spark, str(tmp_path / "x.txt")).collect()
    assert [r.cells for r in out] == want
    assert [r.row_number for r in out] == list(range(1, len(want) + 1))
    assert all(r.key == next(c for c in r.cells if c) for r in out)


def test_sinks(spark, tmp_path):
    a, b = spark.range(3).toDF("k"), spark.range(5).toDF("k")
    path = str(tmp_path / "t")
    sinks.replace_table(a, path)
    sinks.replace_table(b, path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.write_both(b, path, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 5
    view = str(tmp_path / "v")
    sinks.materialise_view(spark.createDataFrame([(1, "a"), (2, "b")], "k int, g string"), view, "g")
    sinks.materialise_view(spark.createDataFrame([(3, "a")], "k int, g string"), view, "g")
    assert sorted(map(tuple, spark.read.parquet(view).collect())) == [(2, "b"), (3, "a")]
    sinks.append_journal(a, str(tmp_path / "j"))
    sinks.append_journal(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    assert sinks.backup(a, path, "1") == sinks.backup(b, path, "1") and spark.read.parquet(path + ".backup-1").count() == 3
    df, seen = sinks.audited(a, "step")
    df.collect()
    assert seen.get["rows"] == 3


def test_flatten_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"value": "x", "c": {"d": 2}}}',), ("nope",)], "j string")
    out = df.select(readers.flatten_json(F.col("j")).alias("m")).collect()
    assert out[0].m["a"] == "1" and out[0].m["b"] == "x" and out[0].m["d"] == "2"
    assert out[1].m in ({}, None)


# ---------------------------------------------------------------- state


START = datetime(2024, 1, 1)


def test_rate_limit_window_opens_with_the_first_event(spark):
    times = [START + timedelta(seconds=2 * k) for k in range(25)] + [START + timedelta(seconds=61)]
    df = spark.createDataFrame([("k", k, t) for k, t in enumerate(times)], "k string, i int, at timestamp")
    out = X.rate_limit(df, "k", "at", ["i"]).orderBy("i").collect()
    assert [r.allowed for r in out] == [True] * 20 + [False] * 5 + [True]


def test_statuses(spark):
    df = spark.createDataFrame([("m", 1, "delivered"), ("m", 2, "sent"), ("n", 1, "weird"), ("o", 1, "failed")], "k string, i int, s string")
    assert {r.k: r.status for r in X.last_status(df, "k", ["i"], "s").collect()} == {"m": "sent", "n": "sent", "o": "failed"}
    assert {r.k: r.status for r in X.last_status(df, "k", ["i"], "s", True).collect()} == {"m": "delivered", "n": "sent", "o": "failed"}


def test_state_machine_stream_equals_batch(spark, sf, tmp_path):
    words = ["start", "fr", "accept", "theme", "ask", "menu", "back", "stop", "hello"]
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 9 + 1).cast("int"))
    table = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", word.alias("control"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = X.batch_states(table, "user_id", ["event_id"], "control", X.CONVERSATION, "awaiting_language")
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = X.stream_states(stream, "user_id", "event_id", "control", X.CONVERSATION, "awaiting_language")
    q = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == {tuple(r) for r in batch.collect()}


def test_stream_dedup_gate_and_merge(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    e.union(e).coalesce(1).write.parquet(str(tmp_path / "in"))
    refused = spark.createDataFrame([(u, "refused") for u in range(5)], "user_id long, consent_status string")
    stream = X.gate(X.stream_new(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), ["event_id"]), refused, "user_id", ["refused"])
    target = str(tmp_path / "out")
    X.stream_into_table(stream, lambda df, n: df.write.mode("append").parquet(target), str(tmp_path / "cp"))
    assert spark.read.parquet(target).count() == e.where("user_id >= 5").count()


def test_opt_out(spark):
    prefs = spark.createDataFrame([(1, "active"), (1, "opted_out"), (2, "active")], "k int, status string")
    new, history = X.opt_out(prefs, spark.createDataFrame([(1,)], "k int"), "k", "2024-01-01")
    assert sorted(map(tuple, new.collect())) == [(1, "opted_out"), (1, "opted_out"), (2, "active")] and history.count() == 1
    c = spark.createDataFrame([(1, "accepted", "1"), (2, "accepted", "2"), (3, "accepted", None)], "k int, consent_status string, consent_version string")
    assert [r.k for r in X.needs_prompt(c, "2").collect()] == [1]


def test_cosines_of_all_pairs(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [2.0]), (6, [None, 2.0]), (7, [-3.0, 0.0])]
    v = spark.createDataFrame(rows, "i long, v array<double>")
    q = v.select(F.col("i").alias("q"), "v")
    want = sorted((r.q, r.i, r.c) for r in v.crossJoin(q.withColumnRenamed("v", "w")).select("q", "i", F.round(cosine(F.col("v"), F.col("w")), 6).alias("c")).collect())
    for size in (S.QUERY_BYTES, 40):
        monkeypatch.setattr(S, "QUERY_BYTES", size)
        out = S.cosines(v, q, "i", "v", "q")
        assert sorted((r.q, r.i, r.cosine) for r in out.collect()) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "NestedLoop" not in plan


def test_additive_hybrid_of_classes_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [[1.0, 0.0], [0.6, 0.8], [-1.0, 0.5], [0.0, 0.0], [1.0], [], None]
    lines = ["red ring", "red bolt", "ring", None, ""]
    docs = [(i, rng.choice(vectors), rng.choice(lines)) for i in range(200)]
    asked = [(i, rng.choice(vectors), rng.choice([["red", "ring", "red"], ["bolt"], [], None, ["none", None]])) for i in range(60)]
    want = []
    for q, y, t in asked:
        scored = []
        for i, x, h in docs:
            if x is not None and y is not None and len(x) == len(y):
                n = math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
                told = set(t or [])
                s = (sum(a * b for a, b in zip(x, y)) / n if n else 0.0) + (sum(w is not None and h is not None and w in h for w in told) / len(told) if told else 0.0)
                scored += [(-round(s, 9), i)] if round(s, 9) > 0 else []
        want += [(q, i, round(-s, 6), r + 1) for r, (s, i) in enumerate(sorted(scored)[:4])]
    d = spark.createDataFrame(docs, "i long, x array<double>, h string")
    q = spark.createDataFrame(asked, "q long, y array<double>, t array<string>")
    for size in (S.QUERY_BYTES, 100):  # one block of queries, and several
        monkeypatch.setattr(S, "QUERY_BYTES", size)
        out = S.additive_hybrid(d, q, "i", "x", "h", "q", "y", "t", 4)
        assert sorted((r.q, r.id, round(r.score, 6), r.rank) for r in out.collect()) == sorted(want)
    twice = S.additive_hybrid(d.unionAll(d.withColumn("i", F.col("i") + 1000)), q, "i", "x", "h", "q", "y", "t", 4)
    plan = twice._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "size(v" not in plan  # no join of every row with every query


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_top_words_where_the_documents_are(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS", 3)
    rows = [(1, "with Zebra zebra apple APPLE pear 12345 öäü1 the"), (2, None), (3, ""), (4, "pear plum pear plum plum"), (None, "kiwi's")]
    df = spark.createDataFrame(rows, "id long, t string")
    one = C.top_words(df, "id", "t", ["with"], 3)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    want = [(None, "kiwi's", 1, 1), (1, "apple", 2, 2), (1, "pear", 1, 3), (1, "zebra", 2, 1), (4, "pear", 2, 2), (4, "plum", 3, 1)]
    assert sorted(map(tuple, one.collect()), key=lambda r: (r[0] or 0, r[1])) == want
    several = C.top_words(df.unionByName(spark.createDataFrame([(4, "pear pear fig2"), (None, "kiwi's")], df.schema)), "id", "t", ["with"], 3)
    got = {(r.id, r.word): r.n for r in several.collect()}
    assert got[4, "pear"] == 4 and got[None, "kiwi's"] == 2 and several.schema == one.schema


def test_blanks_at_the_ends_and_structure_letters(spark):
    """What is asked before a pattern loses no match."""
    space = "".join(map(chr, (0x1C, 0x1F, 0x85, 0xA0, 0x2003, 0x2028, 9, 10, 13)))
    texts = [f"{a}x y{b}" for a in ("", *space, space) for b in ("", *space, space)] + ["", " ", space, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumns({"have": C._strip(F.col("t")), "want": F.regexp_replace("t", C._EDGES, "")})
    assert all(r.have == r.want for r in df.collect()) and "when" in str(C._strip(F.col("t"))).lower()
    lines = ["ſection II", "SOUS-SECTION I a", "titre 1er", "Art. 5 :", "المادة ٣", "القسم أ", "chapitre X", " titre II", "x TITRE I", "", None]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in lines], "t string").select(*[C.level_label(F.col("t"), k).isNotNull() for k in ("title", "chapter", "section", "article")]).collect()]
    assert [r.index(True) if True in r else None for r in got] == [2, 2, 0, 3, 3, 2, 1, None, None, None, None]
    flat = spark.createDataFrame([("a\t b\n\nc  d e",), ("A B C D E F G H I J K L",), ("A B C D E F G H I J K L M",)], "t string")
    from tessella.functions import text as T
    assert [tuple(r) for r in flat.select(T.one_line(F.col("t")), T.looks_like_heading(F.col("t"))).collect()] == [("a b c d e", False), ("A B C D E F G H I J K L", True), ("A B C D E F G H I J K L M", False)]
