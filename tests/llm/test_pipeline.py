from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tessella.llm import quality, queries

from . import brute


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_run_equals_the_stages_by_hand(spark, sf, documents):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.classify(docs, labels).collect() if r.kept}
    rows = [(i, documents[i].text, documents[i].source) for i in sorted(kept)]
    near = brute.near_duplicates([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if near[r[0]][2]]
    cut = brute.repeated_bytes([(i, t) for i, t, _ in rows])
    rows = [(i, bytes(x for x, y in zip(*cut[i]) if not y).decode("utf-8", "ignore"), s) for i, _, s in rows]
    taken = brute.mix(rows)
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for (i, t, _), (n, size, target, words) in zip(rows, taken):
        rate = target / size if size else 0.0
        copies = int(rate) + (brute.draw(i, t) < rate - int(rate))
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += copies
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in out) == +want
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048


def test_stages_keep_the_columns_of_documents(spark, sf):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, empty, sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run_on_the_smallest_tables(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0
