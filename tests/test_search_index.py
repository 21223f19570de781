"""The stored index against plain Python, in one batch and in several, with replaced documents."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import retrieval as S
from tessella.operators import search_index as I


def words(text):
    return [w for w in re.sub(r"\W+", " ", (text or "").lower()).split() if len(w) > 1]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)] + ["the"] * 20
    rows = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) for k in range(120)}
    return rows | {200: None, 201: "", 202: "the the the", 203: "the " * 500}


QUERIES = {1: "the w1 w2", 2: '"w1 w2"', 3: '"the w3" w4 or w5 -the', 4: "w6 -w7 -\"the w8\"", 5: "-the", 6: "nothing here", 7: "", 8: None, 9: "the", 10: "OR w9 or", 11: '"the the"', 12: "w10-w11"}


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "q long, ask string")


def make(spark, path, batches):
    index = I.SearchIndex(spark, str(path))
    for b in batches:
        index.add(spark.createDataFrame([(k, t, "clash") for k, t in b], "id long, body string, term string").repartition(2), "id", "body")
    return index


@pytest.fixture(scope="module", params=["one batch", "replaced", "compacted"])
def index(request, spark, texts, tmp_path_factory):
    rows = list(texts.items())
    if request.param == "one batch":
        return make(spark, tmp_path_factory.mktemp("a"), [rows])
    old = [(k, "w1 w2 w3 the old one") for k, _ in rows[:40]]
    out = make(spark, tmp_path_factory.mktemp("b"), [old + rows[40:80], rows[:30], rows[30:40] + rows[80:]])
    if request.param == "compacted":
        out.compact()
        assert len(out._segments()) == 1
    return out


def holds(t, run):
    return any(t[i : i + len(run)] == run for i in range(len(t)))


def matched(ask, t):
    alternatives = [[]]
    for item in re.findall(r'-?"[^"]*"|\S+', ask or ""):
        if item.lower() == "or":
            alternatives.append([])
        elif words(item):
            alternatives[-1].append((item.startswith("-"), words(item)))
    return any(a and all(holds(t, run) != no for no, run in a) for a in alternatives)


def test_counts_and_lengths(spark, texts, index):
    want = {}
    for t in texts.values():
        for w in set(words(t)):
            df, n = want.get(w, (0, 0))
            want[w] = df + 1, n + words(t).count(w)
    assert {r.term: (r.df, r.total) for r in index.term_stats().collect()} == want
    n, mean = index.stats()
    assert n == len(texts) and math.isclose(mean, sum(max(1, len(words(t))) for t in texts.values()) / n)
    assert {r.doc for r in index.documents().collect()} == set(texts)


@pytest.mark.parametrize("n", [3, 1000])
def test_ranks_equal_those_of_a_scan(spark, texts, index, queries, n):
    docs = spark.createDataFrame(list(texts.items()), "id long, body string")
    plain = S.term_scores(docs, queries, "id", "body", "q", "ask").withColumn("score", F.round("score", 6))
    have = index.scores(queries, "q", "ask", n)
    for column in ("score", "hits"):
        a, b = (S.ranked(x.select("q", "doc", F.col(column).cast("double").alias("score")), "q", "doc", n).collect() for x in (plain, have))
        assert sorted((r.q, r.rank, r.doc, round(r.score, 5)) for r in a) == sorted((r.q, r.rank, r.doc, round(r.score, 5)) for r in b)


def test_ranks_of_a_few_queries_at_once(spark, texts, tmp_path, queries, monkeypatch):
    index = make(spark, tmp_path / "steps", [list(texts.items())])
    whole = sorted(map(tuple, index.scores(queries, "q", "ask", 3).collect()))
    monkeypatch.setattr(I, "SCORES", 1)  # each query by itself, which bounds what a task holds
    assert sorted(map(tuple, index.scores(queries, "q", "ask", 3).collect())) == whole


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Short texts of few words in many blocks, much the same, so that equal ranks abound; questions are some of them and longer ones."""
    rng = random.Random(7)
    draw = lambda k: [f"w{min(rng.randrange(40), rng.randrange(40)):02}" for _ in range(k)]
    rows = {k: " ".join(["all", *draw(rng.randrange(1, 6))]) for k in rng.sample(range(10**6), 1500)}
    asks = {i: t for i, t in enumerate([*list(rows.values())[::50], "all", "all w00", " ".join(draw(30)), " ".join(f"w{k:02}" for k in range(40)), "nothing"])}
    asks[99] = " ".join(["all w01 w01", *(f"x{k}" for k in range(300))])
    rows[-1] = asks[99]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # texts of a block
    index = make(spark, tmp_path_factory.mktemp("alike"), [list(rows.items())])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert index._raw(1, "block").distinct().count() >= 30
    return rows, asks, index


def plain_ranks(rows, asks, n):
    """For each question the n best by score and by hits: (document, score, hits)."""
    count = {d: {w: words(t).count(w) for w in words(t)} for d, t in rows.items()}
    size = {d: max(1, sum(c.values())) for d, c in count.items()}
    mean, df = sum(size.values()) / len(rows), {}
    for c in count.values():
        for w in c:
            df[w] = df.get(w, 0) + 1
    idf, out = {w: math.log(1 + (len(rows) - k + 0.5) / (k + 0.5)) for w, k in df.items()}, {}
    for q, ask in asks.items():
        terms, found = sorted(set(words(ask))), []
        for d, c in count.items():
            held = [w for w in terms if w in c]
            if held:
                found.append((d, round(sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * size[d] / mean)) for w in held), 6), len(held)))
        out[q] = [[(d, s, h) for d, s, h in sorted(found, key=lambda x: (-x[i], x[0]))[:n]] for i in (1, 2)]
    return out, idf, mean


@pytest.mark.parametrize("together", [1, 300, 10**6])
def test_only_documents_near_the_best_are_scored(alike, monkeypatch, together):
    rows, asks, index = alike
    want, idf, mean = plain_ranks(rows, asks, 5)
    names = list(asks)
    by = {w: (x, np.array([i for i, q in enumerate(names) if w in words(asks[q])])) for w, x in idf.items()}
    table = index._raw(1, "*").where("term is not null").sort("block", "term").toArrow()
    scored = []
    real = I._Postings._scored
    monkeypatch.setattr(I._Postings, "_scored", lambda self, *a: scored.append(real(self, *a)) or scored[-1])
    for room in (1, 1 << 20):
        scored.clear()
        best = I._ranks(I._whole_blocks(table.to_batches(max_chunksize=100)), len(names), {w: x for w, x in by.items() if len(x[1])}, 5, mean, together, room)
        for side, k in enumerate(("score", "hits")):
            have = {}
            for q, _, d, s, h in zip(*(x.tolist() for x in best[k])):
                have.setdefault(names[q], []).append((d, s, h))
            assert {q: [(d, round(s, 5), h) for d, s, h in have.get(q, [])] for q in asks} == {q: [(d, round(s, 5), h) for d, s, h in want[q][side]] for q in asks}
        pairs = sum(len(x[0]) for x in scored)
        assert pairs < (0.1 if together > 1 else 0.3) * len(rows) * len(asks)  # every question meets every text by "all"


def test_ranks_of_many_blocks(spark, alike, monkeypatch):
    rows, asks, index = alike
    want, _, _ = plain_ranks(rows, asks, 5)
    queries = spark.createDataFrame(list(asks.items()), "q long, ask string")
    for together, dealt in ((1, 64), (300, 1)):
        monkeypatch.setattr(I, "TOGETHER", together)
        monkeypatch.setattr(I, "DEALT", dealt)
        have = index.scores(queries, "q", "ask", 5)
        for side, column in enumerate(("score", "hits")):
            ranks = S.ranked(have.select("q", "doc", F.col(column).alias("score")), "q", "doc", 5).collect()
            assert {(r.q, r.rank, r.doc) for r in ranks} == {(q, i + 1, x[0]) for q, sides in want.items() for i, x in enumerate(sides[side])}


def test_blocks_are_dealt_out_evenly(spark, alike, queries):
    _, _, index = alike
    tasks, dealt = index._deal()
    n = [r["count"] for r in dealt.groupBy("_task").count().collect()]
    assert len(n) == tasks == spark.sparkContext.defaultParallelism and max(n) - min(n) <= 1
    assert index.scores(queries, "q", "ask", 5).rdd.getNumPartitions() == tasks


def test_full_text_matches(texts, index, queries):
    want = {(q, d) for q, ask in QUERIES.items() for d, t in texts.items() if matched(ask, words(t))}
    have = [(r.q, r.doc) for r in index.matches(queries, "q", "ask").collect()]
    assert sorted(have) == sorted(want) and {q for q, _ in want} >= {1, 3, 4, 5, 9, 11}


def plain_covers(t, terms):
    at = [(i, w) for i, w in enumerate(t) if w in terms]
    score, s = 0.0, 0
    while True:
        e = next((k for k in range(s, len(at)) if {w for _, w in at[s : k + 1]} == terms), None)
        if e is None:
            return score
        b = next(k for k in range(e, s - 1, -1) if {w for _, w in at[k : e + 1]} == terms)
        score += 0.1 / (1 + at[e][0] - at[b][0] - (e - b))
        s = b + 1


def test_cover_density(texts, index, queries):
    want = {}
    for q, ask in QUERIES.items():
        terms = set(words(ask))
        for d, t in texts.items():
            if terms and terms <= set(words(t)):
                want[q, d] = round(plain_covers(words(t), terms), 9)
    have = {(r.q, r.doc): round(r.score, 9) for r in index.cover_density(queries, "q", "ask").collect()}
    assert have == want and len(want) > 100


def test_matches_and_covers_shuffle_postings_only(spark, index, queries):
    for out in (index.matches(queries, "q", "ask"), index.cover_density(queries, "q", "ask")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "explode" not in plan.split("MapInArrow")[0]  # no row for a query and a posting


def test_covers_by_hand():
    assert math.isclose(I.covers([np.array([0, 9]), np.array([3])]), 0.1 / 3 + 0.1 / 6)
    assert math.isclose(I.covers([np.array([2, 5])]), 0.2)


def test_empty_and_text_ids(spark, tmp_path, queries):
    index = make(spark, tmp_path / "e", [[]])
    assert index.scores(queries, "q", "ask", 5).count() == 0 and index.matches(queries, "q", "ask").count() == 0
    index.add(spark.createDataFrame([(1, "the w1"), (None, "the")], "id long, body string"), "id", "body")
    assert [r.doc for r in index.scores(queries, "q", "ask", 5).where("q = 9").collect()] == [1]
    named = I.SearchIndex(spark, str(tmp_path / "n"))
    named.add(spark.createDataFrame([("b", "the w1"), ("a", "the w1")], "id string, body string"), "id", "body")
    assert [r.doc for r in S.ranked(named.scores(queries, "q", "ask", 1), "q", "doc", 1).where("q = 1").collect()] == ["a"]


def test_rank_reads_no_text(spark, index, queries):
    plan = index.scores(queries, "q", "ask", 5)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "CartesianProduct" not in plan
    assert ("places" in plan) == bool(index._gone())  # only to mask what was replaced


def test_tokens_are_those_of_the_index(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "id long, body string").select("id", T.tokens(F.col("body")).alias("t")).collect()
    assert all(r.t == words(texts[r.id]) for r in rows)


def test_a_batch_is_indexed_without_a_shuffle(spark, texts, tmp_path, monkeypatch):
    plans = []
    real = I.VersionedTable.replace
    monkeypatch.setattr(I.VersionedTable, "replace", lambda self, parts, *a, **b: (plans.extend(df._jdf.queryExecution().executedPlan().toString() for df in parts.values()), real(self, parts, *a, **b))[1])
    index = I.SearchIndex(spark, str(tmp_path / "f"))
    index.add(spark.createDataFrame(list(texts.items()), "id long, body string"), "id", "body")
    assert plans and not any("Exchange" in p for p in plans)
    terms = sorted(((r.block, r.term) for r in index._raw(1, "block", "term").collect() if r.term is not None), key=lambda x: x[0])  # stable
    assert terms == sorted(terms) and len(terms) > 30


def test_words_of_a_block_are_the_tokens_of_its_texts(spark, monkeypatch):
    """Words are normalised apart from their text; what stands beside them must not matter."""
    monkeypatch.setattr(I, "BLOCK", 4)
    odd = ["ΟΔΟΣ ΣΑΣ. ΑΣ\tΣ ΣΣ-ΣΑ", "İstanbul İx Straße　ab\x1ccd", " \n\x0b\f\r", "été́ ́ab á", "أحمد مؤمن سائل آخر إلى", "a-b a'bc x.y.zz ab_cd 12,5", "", None, "\U0001d400\U0001d401 \U00010428x 日本語 日",
           "don't  stop\n\nDON'T  stop", "ab " * 9, "ﬁn ǅa  cd\u0085ef", "a b c"]
    docs = spark.createDataFrame(list(enumerate(odd)), "id long, text string").coalesce(1)
    have = {}
    for r in I.index_rows(docs, "id", "text").where("term is not null").collect():
        tfs, places, at = np.frombuffer(r.tfs, np.int32).tolist(), np.frombuffer(r.places, np.int32).tolist(), 0
        for d, tf, n in zip(r.docs, tfs, r.lens):
            have.setdefault((d, n), []).extend((p, r.term) for p in places[at : at + tf])
            at += tf
    want = {(r.id, len(r.t)): list(enumerate(r.t)) for r in docs.select("id", T.tokens(F.col("text")).alias("t")).collect() if r.t}
    assert {k: sorted(v) for k, v in have.items()} == want and len(want) == 9


def test_only_distinct_words_are_normalised_and_vectors_made_once(spark):
    docs = spark.createDataFrame([(1, "ab ab")], "id long, text string")
    plan = I.index_rows(docs, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("MapInArrow"):]
    assert "regexp_replace" in plan and "regexp_replace" not in below
    v, q = docs.select("id", T.hash_vector(F.col("text"), 32).alias("v")), spark.createDataFrame([(7, [1.0] * 32)], "q long, v array<double>")
    assert S.vector_topk(v, q, "id", "v", "q", 3)._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
