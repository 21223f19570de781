"""Queries over tables whose telling words stand late in the texts."""

from __future__ import annotations

import re

import pytest

from tessella.plans import registry, search_queries, text_queries

FILLER = "plain words that say nothing of note and fill the line up to its end " * 8


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("late"))
    docs = [(0, "unrelated start\n" + FILLER + "zebra quagga", "en", "src1"), (1, "another start " + FILLER, "en", "src1"), (2, "third start", "de", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    asked = [(0, "q" * 30 + " " + "r" * 30 + " zebra quagga de la"), (1, "s" * 70)]
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", ["hybrid_rrf", "rt01_tk09_bm25_topk", "rt12_jn01_wn02_sql_rrf", "rt05_rt11_rerank"])
def test_words_after_60_characters_of_a_question_find_their_document(spark, late, name):
    assert [(r.item_id, r.doc) for r in registry.queries()[name](spark, late).collect()] == [(0, 0)]


def test_late_words_of_a_question_in_answers_topics_and_seeds(spark, late):
    q = registry.queries()
    assert [(r.item_id, r.docs) for r in q["rt16_seed_set"](spark, late).collect()] == [(0, "0")]
    assert [r.item_id for r in q["rt15_jn16_answers"](spark, late).collect()] == [0]
    assert [(r.item_id, r.topic) for r in q["rt09_tk06_topic_match"](spark, late).collect()] == [(0, 1)]


def words(text):
    return [t for t in re.sub("[^a-z0-9]+", " ", text.lower()).split() if len(t) > 1]


def test_topical_words_and_slugs_of_whole_texts(spark, late):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{late}/documents.parquet").collect()}
    topical, size = {}, {}
    for i, text in docs.items():
        topical[i] = " ".join(dict.fromkeys(t for t in words(text) if len(t) > 2 and t not in text_queries._STOP))
        more = [a for p, add in text_queries._EXPAND if re.search(p, text) for a in add]
        size[i] = len(set(words(text) + more))
    have = registry.queries()["sf08_sf09_topical_and_expanded"](spark, late).collect()
    assert {r.doc_id: (r.topical, r.n_expanded) for r in have} == {i: (topical[i], size[i]) for i in docs}
    assert topical[0].endswith("zebra quagga")
    slugs = {r.doc_id: r.slug for r in registry.queries()["sf25_slugs"](spark, late).collect()}
    assert slugs == {i: re.sub("[^a-z0-9]+", "-", t.lower()).strip("-") for i, t in docs.items()}


def test_rerank_sees_whole_documents(spark, late):
    n = search_queries.S.candidates(search_queries.K)
    fused = search_queries.S.rrf(search_queries._lexical(spark, late, n), search_queries._keywords(spark, late, n), "item_id", "doc")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{late}/documents.parquet").collect()}
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{late}/benchmark.parquet").collect()}
    want = {}
    for r in fused.collect():
        doc, q = docs[r.doc], words(asked[r.item_id])
        toks, flat = set(words(doc.text)), " ".join(words(doc.text))
        exact = (search_queries.S.EXACT["document"] if any(t in flat for t in q[:2]) else 0) + (search_queries.S.EXACT["label"] if doc.source in asked[r.item_id] else 0)
        topical = 1.4 * min(4, len(set(q) & toks)) + 0.5 * (doc.lang == "en") - (len(words(doc.text)) < 5)
        w = search_queries.S.WEIGHTS
        want[r.item_id, r.doc] = round(r.fused + exact * w["exact"] + topical * w["topical"] - 1.5 * (doc.source == "src0") * w["scope"], 9)
    have = {(r.item_id, r.doc): r.rerank_score for r in registry.queries()["rt05_rt11_rerank"](spark, late).collect()}
    assert have == pytest.approx(want) and have


def test_headings_of_every_line(spark, tmp_path):
    text = "a plain line\nshort answer : yes\nSource\nSources of it\nCHAPTER ONE\n\nArticle 3 : x\nbasis"
    spark.createDataFrame([(0, text), (1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(registry.queries()["sf58_sf60_heading_lines"](spark, str(tmp_path)).collect())
    have = [(r.line, r.blank, r.upper, r.heading, r.article) for r in rows if r.doc_id == 0]
    assert have == [
        ("a plain line", False, False, False, False), ("Answer : yes", False, False, False, False), ("Sources", False, False, False, False),
        ("Sources of it", False, False, False, False), ("CHAPTER ONE", False, True, True, False), ("", True, False, False, False),
        ("Article 3 : x", False, False, False, True), ("Basis", False, False, False, False),
    ]
    assert [(r.doc_id, r.line_no) for r in rows if r.doc_id == 1] == [(1, 0)]


def test_every_stated_query_is_scored(spark, tmp_path):
    words = "a" * 70 + " zebra"
    spark.createDataFrame([(0, "alpha"), (7, "beta"), (100, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, "alpha zebra")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [0.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    q = registry.queries()
    assert sorted((r.item_id, r.doc_id, r.ratio) for r in q["sf33_overlap_ratio_to_queries"](spark, str(tmp_path)).collect()) == [(0, 5, 1.0), (100, 5, 0.5)]
    have = sorted((r.query_id, r.vec_id, r.cosine) for r in q["sf32_cosine_to_queries"](spark, str(tmp_path)).collect())
    assert have == [(0, 0, 1.0), (0, 1, 0.0), (0, 100, 0.0), (100, 0, 0.0), (100, 1, 1.0), (100, 100, 1.0)]


def test_outline_of_whole_documents(spark, tmp_path):
    import duckdb

    text = "plain\nTITRE I Objet\n" + FILLER + "\nCHAPITRE II Suite\nsection 2 b\nArticle 3 : x\nArticle 3 : y"
    spark.createDataFrame([(0, text), (1, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    have = {tuple(r) for r in registry.queries()["ch08_document_outline"](spark, str(tmp_path)).collect()}
    assert have == {(0, "title", "I Objet"), (0, "chapter", "II Suite"), (0, "section", "section 2 b"), (0, "article", "3")}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(con.execute(registry.oracle_sql()["ch08_document_outline"]).fetchall()) == have
