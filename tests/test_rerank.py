"""Feature rerank against a plain version, over the whole table."""

from __future__ import annotations

import re
import unicodedata

from tessella.operators import rerank as RR
from tessella.plans import search_queries as Q


def norm(s):
    s = "".join(c for c in unicodedata.normalize("NFD", (s or "").lower()) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", s)).strip()


def topics(s):
    seen = dict.fromkeys(w for w in norm(s).split(" ") if len(w) > 2 and w not in RR.RULES.stopwords)
    return list(seen)


def refs(text, patterns):
    return {norm(m.group(g)) for p, g in patterns for m in re.finditer(p, text)} - {""}


def plain(chunk, question, scope):
    titles = [chunk.official_title, chunk.short_title]
    corpus = norm(" ".join([*titles, chunk.citation_label, *chunk.cross_references]))
    exact, nq = 0.0, norm(question)
    exact += 8 * (norm(chunk.article_number) in refs(question, RR.ARTICLES))
    exact += 10 * any(r in corpus for r in refs(question, RR.DOCUMENTS)) + 4 * any(r in corpus for r in refs(question, RR.DATES)) + 6 * (norm(chunk.citation_label) in nq)
    qt, ct = topics(question), set(topics(" ".join([str(chunk.doc_id), *titles, chunk.citation_label, *chunk.topics])))
    n, line = sum(t in ct for t in qt), " ".join(qt)
    asks = {m: bool(re.search(p, line)) for m, p in RR.RULES.marks.items()}
    score = min(n, 4) * 1.4
    if asks["equivalence"] and n >= 2 and chunk.document_type in ("decret", "loi", "arrete"):
        score += 1.5
    if asks["equivalence"] and not asks["permit"] and chunk.document_type == "guide_pratique" and re.search("autorisation|exercice", norm(" ".join([*titles, *chunk.topics]))):
        score -= 1.5
    score += 2 * sum(asks[m] and bool(getattr(chunk, m)) for m in ("sanctions", "deadlines", "obligations"))
    if asks["practical"] and chunk.document_type == "guide_pratique":
        score += 5 if n >= 2 else 1 if n == 1 else -1
    in_id = sum(t in qt for t in norm(str(chunk.doc_id)).split(" ") if len(t) > 1)
    score += in_id * 1.5 if in_id >= 2 else 0
    arabic = bool(re.search("[؀-ۿ]", question))
    score += (chunk.language == "ar" and arabic) * 1.0 + (chunk.language == "fr" and not arabic) * 0.5
    score += {"high": 1, "medium": 0.4, "low": -0.5}.get(chunk.confidence, 0) - bool(chunk.manual_review_required)
    score += -1 if chunk.document_type == "autre" else -0.5 if chunk.manual_review_required else 1
    extra = {"regulations": -1.5, "compliance": -0.2}.get(scope, 0) if chunk.document_type == "autre" else 0
    return exact, score, extra


def test_boosts_of_all_pairs_equal_the_plain_version(spark, sf):
    chunks, questions = Q.rule_chunks(spark, sf), Q.rule_questions(spark, sf)
    pairs = chunks.select("doc_id").crossJoin(questions.select("item_id")).selectExpr("item_id", "doc_id AS doc", "CAST(0.5 AS DOUBLE) AS fused")
    by, ask = {r.doc_id: r for r in chunks.collect()}, {r.item_id: r.question for r in questions.collect()}
    for scope in ("regulations", "compliance", None):
        have = RR.rerank(pairs, chunks, questions, "doc_id", "item_id", "question", 10**6, scope).collect()
        assert len(have) == len(by) * len(ask)
        for r in have:
            exact, topical, extra = plain(by[r.doc], ask[r.item_id], scope)
            assert (r.exact, round(r.topical, 9), r.scope) == (exact, round(topical, 9), extra), (by[r.doc], ask[r.item_id])
            assert abs(r.rerank_score - (0.5 + exact * 0.08 + topical * 0.05 + extra * 0.05)) < 1e-8


def test_the_part_of_the_question_comes_first(spark, sf):
    best = [r for r in Q.feature_rerank(spark, sf).collect() if r["rank"] == 1]
    assert sum(r.doc == r.item_id for r in best) >= 0.8 * len(best)


def test_chunks_with_nothing_told(spark):
    chunks = spark.createDataFrame([(1, None), (None, None)], "doc_id long, official_title string")
    questions = spark.createDataFrame([(1, None)], "item_id long, question string")
    fused = spark.createDataFrame([(1, 1, 0.1)], "item_id long, doc long, fused double")
    assert [r.rerank_score for r in RR.rerank(fused, chunks, questions, "doc_id", "item_id", "question", 4).collect()] == [0.15]


def test_features_are_made_of_candidates_only(spark):
    chunks = spark.createDataFrame([(1, "Décret n° 2-11-7"), (2, "x")], "doc_id long, official_title string")
    questions = spark.createDataFrame([(1, "décret n° 2-11-7")], "item_id long, question string")
    fused = spark.createDataFrame([(1, 1, 0.1)], "item_id long, doc long, fused double")
    out = RR.rerank(fused, chunks, questions, "doc_id", "item_id", "question", 4)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = max(i for i, x in enumerate(lines) if "Join Inner" in x)
    made = [i for i, x in enumerate(lines) if "regexp_replace" in x and "official_title" in x]
    assert made and max(made) < join  # not below the join with the candidates
    assert out.columns == ["item_id", "doc", "fused", "exact", "topical", "scope", "rerank_score", "rank"] and [r.exact for r in out.collect()] == [10.0]
