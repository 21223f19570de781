"""References of texts and wide chunk rows against plain versions, on texts that hold them."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking, references
from tessella.operators.references import ACTS, MONTHS
from tessella.operators.rerank import ARTICLES, DATES, DOCUMENTS
from tessella.plans import chunk_queries as Q

TEXTS = [
    (1, "Selon l'article 12 et l'Art. premier, la loi n° 17-04 du 22/11/2006 et le décret n° 2-07-1064 s'appliquent. Article 12 encore."),
    (2, "المادة ٣ والمادة 14 من الظهير شريف رقم 1-06-151 ومرسوم رقم 2-08 و ظهير رقم 5"),
    (3, "BO_5480 du 3 décembre 2006, arrêté 1250-11 du 31/2/2010, 01-02-99 et 05/06/07, art 1er, article 1"),
    (4, None), (5, ""), (6, "nothing of the kind"), (7, "dahir 1-58-008 " * 500 + "article 9"), (1, "article 12"),
]


def norm(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", s)).strip()


def plain(text):
    """(kind, ref, number, date) in order."""
    out = []
    for family, patterns, shape in (("article", ARTICLES, lambda s: s.strip().lower()), ("act", DOCUMENTS, norm), ("date", DATES, norm)):
        refs = dict.fromkeys(r for p, g in patterns for m in re.finditer(p.replace("(?iu)", "(?i)"), text or "") if (r := shape(m.group(g))))
        for r in refs:
            kind, number, day = family, None, None
            if family == "article":
                number = "1" if r in ("premier", "1er") else "".join(str(int(c)) if c.isdigit() else c for c in r)
            elif family == "act":
                kind, number = ACTS[re.match(r"[^\d\s]+", r).group()], re.search(r"\d[\d ]*$", r).group().replace(" ", "-")
            else:
                d, m, y = r.split(" ")
                y = int(y) if len(y) == 4 else int(y) + (1900 if int(y) >= 70 else 2000)
                try:
                    day = None if len(r.split(" ")[2]) == 3 else date(y, int(m) if m.isdigit() else MONTHS.index(m) + 1, int(d))
                except ValueError:
                    day = None
            out.append((kind, r, number, day))
    return out


def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "id long, text string, rank string")


def test_reference_rows_equal_the_plain_version(spark):
    have = references.reference_table(frame(spark), "id", "text").collect()
    want = [(i, k, *row) for i, t in TEXTS for k, row in enumerate(plain(t))]
    assert sorted(map(repr, map(tuple, have))) == sorted(map(repr, want))
    assert {r.kind for r in have} == {"article", "law", "decree", "dahir", "order", "gazette", "date"}


def test_references_find_what_they_name_and_come_back(spark):
    chunks = frame(spark).where("id <> 1").drop("rank")
    registry = spark.createDataFrame([("dahir", "1-58-008", 70), ("dahir", "1-58-008", 71), ("order", "1250-11", 30), ("order", None, 1), (None, None, 2)], "kind string, number string, target long")
    found = references.resolve(references.reference_table(chunks, "id", "text"), registry)
    rows = {r.id: r for r in references.with_references(chunks, "id", found).collect()}
    assert rows[7].targets == [70] and rows[7].acts == ["dahir 1-58-008"] and rows[7].n_resolved == 1 and rows[7].articles == ["9"]
    assert rows[3].targets == [30] and rows[3].articles == ["1"] and rows[3].first_date == date(1999, 2, 1) and rows[3].last_date == date(2007, 6, 5)
    for i in (4, 5, 6):
        assert rows[i].n_references == 0 and rows[i].targets == [] and rows[i].first_date is None
    assert references.reference_table(chunks.limit(0), "id", "text").count() == 0


def test_wide_chunks(spark):
    rows = [(1, "Le registre est tenu.\nToutefois l'article 4 prévoit une amende. On entend par navire un bâtiment. Mail: a@b.org", "Code du port", "Titre I", "4", 2, 3), (2, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, body string, title string, path string, article string, first int, last int")
    got = {r.id: r for r in chunking.wide_chunks(df, "body", "title", "path", "article", "first", "last", Q.WIDE).collect()}
    r = got[1]
    assert r.key_rules == ["Le registre est tenu."] and r.exceptions == r.sanctions == ["Toutefois l'article 4 prévoit une amende."]
    assert r.definitions == ["On entend par navire un bâtiment."] and r.citations == ["article 4"] and r.topics == ["contact"]
    assert r.citation_label == "Code du port — Titre I — art. 4 — p. 2-3"
    assert r.content_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert {"contact", "adresse", "code", "port", "titre", "article 4", "المادة 4", "registre", "navire"} <= set(r.retrieval_keywords)
    assert r.retrieval_keywords == sorted(r.retrieval_keywords) and len(r.retrieval_keywords) <= 30
    e = got[2]
    assert e.citations == e.key_rules == [] and e.content_sha256 == hashlib.sha256(b"").hexdigest() and e.topics == ["general"]


def test_tests_before_patterns_lose_no_match(spark):
    """Letters that a pattern takes for others when it ignores case, and rows that share an id or have none; chunks keep their own source."""
    texts = ["IL DOıT payer. Rien. L'eſt aussi. On  ENTEND par là", "ARTİCLE 5 et ARTıCLE 6, LOI N° 3", "toutefois, la SANCTıON", "sauf rien\nil doit", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [p for ps in Q.LINES.values() for p in ps]
    got = {r.t: (r.k, r.x) for r in df.select("t", T.key_lines(F.col("t"), patterns, 9).alias("k"), T.cross_references(F.col("t")).alias("x")).collect()}
    hit = lambda s: reduce(lambda a, b: a | b, [F.lower(s).rlike("(?iU)" + p) for p in patterns])
    want = {r.t: r.k for r in df.select("t", F.filter(T.sentences(F.col("t")), hit).alias("k")).collect()}
    assert {t: k for t, (k, _) in got.items()} == want and len(want[texts[0]]) == 3
    wide = chunking.wide_chunks(df.select("t", F.lit("a").alias("s"), F.lit("x").alias("l"), F.lit(None).cast("string").alias("art"), F.lit(1).alias("p")), "t", "s", "l", "art", "p", "p", Q.WIDE).collect()
    assert {r.t: r.citations for r in wide} == {t: x for t, (_, x) in got.items()} and got[texts[1]][1] == ["ARTİCLE 5", "ARTıCLE 6", "LOI N° 3"]
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, source string").withColumn("text", F.col("source"))
    assert sorted((r.chunk, r.source) for r in chunking.paragraph_chunks(docs, "doc_id", "text", more=("source",)).collect()) == [("a", "a"), ("b", "b"), ("c", "c")]


def test_references_stay_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables whose size is not known
    try:
        rows = references.reference_table(frame(spark), "id", "text")
        known = spark.createDataFrame([("law", "17-04", 5), ("law", "17-04", 3)], "kind string, number string, target int").repartition(3)
        out = references.resolve(rows, known)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.target for r in out.where("kind = 'law'").collect()} == {3} and out.count() == rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_known_acts_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(references, "MOST_SENT", 1)
    rows = references.reference_table(frame(spark), "id", "text")
    known = spark.createDataFrame([("law", "17-04", 5), ("decree", "2-08", 3)], "kind string, number string, target int")
    assert {(r.kind, r.target) for r in references.resolve(rows, known).where("target is not null").collect()} == {("law", 5), ("decree", 3)}
