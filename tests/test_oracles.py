"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tessella.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    have = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert have == want


def test_opening_words_end_before_accented_letters(spark, duck, tmp_path):
    turns = [(1, 0, "user", "eins\nzwei\nleçon\nLE mot\nle_x\ntheé 3\ndie"), (1, 1, "bot", "le\nlèche\nthes"), (2, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    cur = duck.cursor()
    cur.execute(f"CREATE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = cur.execute(registry.oracle_sql()["rt10_tk05_line_ranking"]).fetchall()
    have = registry.queries()["rt10_tk05_line_ranking"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, have)) == sorted(want) and any(r.line == "leçon" and r.score > 11 for r in have)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs_and_repeats(spark, sf, name):
    f = registry.queries()[name]
    first = sorted(map(str, f(spark, sf).collect()))
    assert first and first == sorted(map(str, f(spark, sf).collect()))


def test_no_query_makes_a_cartesian_product_or_reads_all_columns(spark, sf):
    plan = registry.queries()["rt01_tk09_bm25_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    plan = registry.queries()["pf01_pf02_equal_filters"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "o_orderdate" not in plan
