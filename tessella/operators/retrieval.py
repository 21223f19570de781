"""Search: term statistics, BM25, cosine, fusion, rerank.

Many queries are answered in one job. Scores come from joins on terms, never from a scan of every
document for every query; per-query top-k is a ranked window, which Spark cuts before the shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.vectors import cosine, norm

# fixed values of the ranking
K1, B, RRF_K, PER_TOKEN = 1.5, 0.75, 60, 3.0
WEIGHTS = {"exact": 0.08, "topical": 0.05, "scope": 0.05}
EXACT = {"article": 8, "document": 10, "date": 4, "label": 6}

#: Bytes of the vectors of a block of queries, about; scores that a task holds at once.
QUERY_BYTES, SCORES = 32 << 20, 1 << 21


def term_stats(docs: DataFrame, ident: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tf, df, stats): term counts of each document, documents of each term, and n_docs and avg_len."""
    toks = docs.select(F.col(ident).alias("doc"), T.tokens(F.col(text)).alias("toks"))
    tf = toks.select("doc", F.explode("toks").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    length = F.greatest(F.size("toks"), F.lit(1))
    stats = toks.agg(F.count("*").alias("n_docs"), F.avg(length).alias("avg_len"))
    return tf, df, stats


def term_scores(docs: DataFrame, queries: DataFrame, ident: str, text: str, query_id: str, query: str) -> DataFrame:
    """query_id, doc, score (BM25) and hits (PER_TOKEN for each distinct term) of every document that shares a term.

    Only postings of query terms leave the scan, and both scores come from the same postings.
    """
    q = queries.select(query_id, F.explode(F.array_distinct(T.tokens(F.col(query)))).alias("term"))
    toks = docs.select(F.col(ident).alias("doc"), T.tokens(F.col(text)).alias("toks"))
    toks = toks.withColumn("len", F.greatest(F.size("toks"), F.lit(1)))
    stats = toks.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    terms = q.select("term").distinct()
    hits = toks.select("doc", "len", F.explode("toks").alias("term")).join(terms, "term", "left_semi")
    tf = hits.groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    joined = tf.join(df, "term").join(q, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return joined.groupBy(query_id, "doc").agg(F.sum(idf * part).alias("score"), (F.count("*") * PER_TOKEN).alias("hits"))


def bm25(docs: DataFrame, queries: DataFrame, ident: str, text: str, query_id: str, query: str) -> DataFrame:
    """query_id, doc, score of every document that shares a term with the query."""
    return term_scores(docs, queries, ident, text, query_id, query).select(query_id, "doc", "score")


def _by_length(column):
    """(length, places, vectors, which have a direction) of the vectors of an Arrow column, with vectors made unit, or 0 without a direction."""
    lens = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False)
    begin = np.cumsum(lens) - lens
    for d in np.unique(lens).tolist():
        at = np.flatnonzero(lens == d)
        x = flat[begin[at][:, None] + np.arange(d)]
        n = np.sqrt((x * x).sum(1))
        some = np.isfinite(n) & (n > 0)
        yield d, at, np.where(some[:, None], x, 0.0) / np.where(some, n, 1.0)[:, None], some


def _unit_vectors(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: the places of the vectors of an Arrow column that have a direction, and these."""
    return {d: (at[some], x[some]) for d, at, x, some in _by_length(column) if d > 0}


def _best(q: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int):
    """The k greatest scores of each q, of equal ones those of least id."""
    o = np.lexsort((ident, -score, q))
    q, score, ident = q[o], score[o], ident[o]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])[: len(q)]
    some = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
    return q[some], score[some], ident[some]


def _block_topk(vectors: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """_q, id, score: for each query of a block the k best of each task, by matrix products."""
    told = block.toArrow().combine_chunks()
    held = vectors.sparkSession.sparkContext.broadcast((pa.array(told.column("id").to_pylist(), told.schema.field("id").type), _unit_vectors(told.column("v").combine_chunks())))

    def run(batches):
        asked, of_length = held.value
        best, kind = None, None
        for batch in batches:
            ids, kind = batch.column("id").to_numpy(zero_copy_only=False), batch.column("id").type
            for d, (at, x) in _unit_vectors(batch.column("v")).items():
                if d not in of_length or not len(at):
                    continue
                q_at, y = of_length[d]
                step = max(1, SCORES // len(at))
                for i in range(0, len(q_at), step):
                    s = np.round(y[i : i + step] @ x.T, 12)
                    edge = np.partition(s, len(at) - k, axis=1)[:, [len(at) - k]] if len(at) > k else 0.0
                    r, c = np.nonzero((s >= edge) & (s > 0))
                    new = _best(q_at[i + r], s[r, c], ids[at[c]], k)
                    best = new if best is None else _best(*(np.concatenate(pair) for pair in zip(best, new)), k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(best[0])), pa.array(best[2], kind), pa.array(best[1])], ["_q", "id", "score"])

    schema = block.select(F.col("id").alias("_q")).schema.add("id", vectors.schema["id"].dataType).add("score", "double")
    return vectors.mapInArrow(run, schema)


def vector_topk(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, query_id: str, k: int) -> DataFrame:
    """query_id, id, score, rank: the k vectors of greatest positive cosine for each of a stated set of queries.

    The queries go in blocks of about QUERY_BYTES, each broadcast for one pass over the vectors; of every task
    and query only the k best are shuffled. Vectors that are null, zero or not finite, of another length or
    without an id match nothing; a null component is 0. Cosines count to 12 digits, equal ones go by id.
    """
    v = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")  # a filter on v would make it twice
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    size = q.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // QUERY_BYTES))
    parts = [_block_topk(v, q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i), k) for i in range(blocks)]
    found = reduce(DataFrame.union, parts).select(F.col("_q").alias(query_id), "id", "score")
    return ranked(found, query_id, "id", k)


def _block_cosines(vectors: DataFrame, block: DataFrame, query_id: str, ident: str) -> DataFrame:
    told = block.toArrow().combine_chunks()  # about QUERY_BYTES
    held = vectors.sparkSession.sparkContext.broadcast((told.column("id").combine_chunks(), _raw_vectors(told.column("v").combine_chunks())))

    def run(batches):
        names, (asked, of) = held.value
        for batch in batches:
            own, mine = _raw_vectors(batch.column("v"))
            n_rows = batch.num_rows
            step = max(1, (SCORES >> 3) // max(1, n_rows))
            for i in range(0, len(names), step):
                out = np.zeros((min(step, len(names) - i), n_rows))
                for d, (at, x, n) in mine.items():
                    q_at, y, m = of.get(d, (np.zeros(0, np.int64), None, None))
                    some = slice(*np.searchsorted(q_at, [i, i + step]))
                    if some.start < some.stop:
                        size = m[some, None] * n
                        with np.errstate(all="ignore"):
                            out[np.ix_(q_at[some] - i, at)] = np.where(size == 0, 0.0, np.round(y[some] @ x.T / size, 6))
                q = names.take(pa.array(np.repeat(np.arange(i, i + len(out)), n_rows)))
                ids = batch.column("id").take(pa.array(np.tile(np.arange(n_rows), len(out))))
                yield pa.RecordBatch.from_arrays([q, ids, pa.array(out.ravel())], [query_id, ident, "cosine"])

    schema = block.select(F.col("id").alias(query_id)).schema.add(ident, vectors.schema["id"].dataType).add("cosine", "double")
    return vectors.mapInArrow(run, schema)


def _raw_vectors(column):
    """How many vectors an Arrow column has, and for each length the places, vectors and norms; null components are 0."""
    lens = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False)
    begin, out = np.cumsum(lens) - lens, {}
    for d in np.unique(lens[lens > 0]).tolist():
        at = np.flatnonzero(lens == d)
        x = flat[begin[at][:, None] + np.arange(d)]
        out[d] = at, x, np.sqrt((x * x).sum(1))
    return len(lens), out


def cosines(vectors: DataFrame, queries: DataFrame, ident: str, vector: str, query_id: str) -> DataFrame:
    """query_id, ident, cosine (6 digits) of every vector with every query: as many rows as there are pairs, by matrix
    products in blocks. Vectors of another length, null or zero count 0."""
    v = vectors.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = q.agg(F.sum(8 * F.coalesce(F.size("v"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // QUERY_BYTES))
    return reduce(DataFrame.union, [_block_cosines(v, q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i), query_id, ident) for i in range(blocks)])


def _shares(words: list[list[str | None]], haystacks: pa.Array, found: dict[str, np.ndarray]) -> np.ndarray:
    """For each list of distinct words (rows) the share that each haystack contains; found keeps what was looked up."""
    out = np.zeros((len(words), len(haystacks)))
    for row, told in zip(out, words):
        for w in told:
            if w is not None and w not in found:
                if len(found) * len(haystacks) > 16 * SCORES:
                    found.clear()
                found[w] = pc.fill_null(pc.match_substring(haystacks, w), False).to_numpy(zero_copy_only=False)
            if w is not None:
                row += found[w]
        row /= max(1, len(told))
    return out


def _block_additive(classes: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """v, t, id, score: for each query of a block (v, t) the k best of each task."""
    told = block.toArrow().combine_chunks()  # about QUERY_BYTES
    asked_v, asked_t = (told.column(c).combine_chunks() for c in ("v", "t"))
    held = classes.sparkSession.sparkContext.broadcast((asked_v, asked_t, {d: (at, x) for d, at, x, _ in _by_length(asked_v)}))

    def run(batches):
        asked_v, asked_t, of_length = held.value
        words = [list(dict.fromkeys(t)) for t in asked_t.to_pylist()]
        best, kind = None, None
        for batch in batches:
            lists, coded = batch.column("ids"), batch.column("h").dictionary_encode(null_encoding="encode")
            n_ids, kind = np.asarray(lists.value_lengths()).astype(np.int64), lists.type.value_type
            begin, ids = np.cumsum(n_ids) - n_ids, lists.flatten().to_numpy(zero_copy_only=False)
            line, found = np.asarray(coded.indices), {}
            for d, at, x, _ in _by_length(batch.column("v")):
                q_at, y = of_length.get(d, ((), None))
                step = max(1, SCORES // (len(at) * k))
                for i in range(0, len(q_at), step):
                    some = q_at[i : i + step]
                    s = np.round(y[i : i + step] @ x.T + _shares([words[q] for q in some], coded.dictionary, found)[:, line[at]], 9)
                    edge = np.partition(s, len(at) - k, axis=1)[:, [len(at) - k]] if len(at) > k else 0.0
                    r, c = np.nonzero((s >= edge) & (s > 0))
                    n = n_ids[at[c]]  # a class stands for its ids
                    member = np.repeat(begin[at[c]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    new = _best(np.repeat(some[r], n), np.repeat(s[r, c], n), ids[member], k)
                    best = new if best is None else _best(*(np.concatenate(pair) for pair in zip(best, new)), k)
        if best is not None:
            q = pa.array(best[0])
            yield pa.RecordBatch.from_arrays([asked_v.take(q), asked_t.take(q), pa.array(best[2], kind), pa.array(best[1])], ["v", "t", "id", "score"])

    schema = block.select("v", "t").schema.add("id", classes.schema["ids"].dataType.elementType).add("score", "double")
    return classes.mapInArrow(run, schema)


def additive_hybrid(docs: DataFrame, queries: DataFrame, ident: str, vector: str, haystack: str, query_id: str, query_vector: str, query_tokens: str, k: int) -> DataFrame:
    """query_id, id, score, rank by cosine plus the share of query tokens found in the haystack (positive sums only).

    Rows of equal vector and haystack are one class, which stands for its k least ids, and equal queries are one query; every
    query meets every class, in blocks of queries of about QUERY_BYTES by matrix products. Of every task and query only the k
    best are shuffled. Scores count to 9 digits, equal ones go by id. Rows without a vector or an id match nothing; a
    vector that is zero or not finite has cosine 0.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    d = docs.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(haystack).alias("h")).where("id is not null and v is not null")
    least = d.withColumn("_n", F.row_number().over(Window.partitionBy("v", "h").orderBy("id"))).where(F.col("_n") <= k)
    classes = least.groupBy("v", "h").agg(F.collect_list("id").alias("ids")).repartition(4 * cores, "v", "h")
    asked = queries.select(query_id, F.col(query_vector).cast("array<double>").alias("v"), F.coalesce(query_tokens, F.array().cast("array<string>")).alias("t")).where(F.col(query_id).isNotNull() & F.col("v").isNotNull())
    kinds = asked.select("v", "t").distinct()
    size = kinds.agg(F.sum(8 * F.size("v") + 16 * F.size("t") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // QUERY_BYTES))
    parts = [_block_additive(classes, kinds.where(F.pmod(F.xxhash64("v", "t"), F.lit(blocks)) == i), k) for i in range(blocks)]
    found = ranked(reduce(DataFrame.union, parts).withColumn("_q", F.struct("v", "t")), "_q", "id", k)
    return ranked(asked.join(found.drop("_q", "rank"), ["v", "t"]).select(query_id, "id", "score"), query_id, "id", k)


def ranked(scores: DataFrame, query_id: str, ident: str, k: int, score: str = "score") -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc(score), ident)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _rrf_part(c: str, missing_rank: int | None, k: int) -> Column:
    rank = F.col(c) if missing_rank is None else F.coalesce(F.col(c), F.lit(missing_rank))
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def rrf(left: DataFrame, right: DataFrame, query_id: str, ident: str, missing_rank: int | None = None, k: int = RRF_K) -> DataFrame:
    """query_id, id, left_rank, right_rank, fused. A missing rank counts 0, or as missing_rank if that is given."""
    a = left.select(query_id, ident, F.col("rank").alias("left_rank"))
    b = right.select(query_id, ident, F.col("rank").alias("right_rank"))
    both = a.join(b, [query_id, ident], "full_outer")
    return both.withColumn("fused", _rrf_part("left_rank", missing_rank, k) + _rrf_part("right_rank", missing_rank, k))


def rrf_of_scores(scores: DataFrame, query_id: str, ident: str, left: Column, right: Column, n: int, missing_rank: int | None = None, k: int = RRF_K) -> DataFrame:
    """rrf() of the n best by two columns of one table, which is computed once: both rankings are one window."""
    side = lambda i, c: F.struct(F.lit(i).alias("_side"), c.cast("double").alias("_score"))
    rows = scores.select(query_id, ident, F.explode(F.array(side(0, left), side(1, right))).alias("_s")).select(query_id, ident, "_s.*")
    w = Window.partitionBy(query_id, "_side").orderBy(F.desc("_score"), ident)
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    of = lambda i: F.max(F.when(F.col("_side") == i, F.col("rank")))
    both = top.groupBy(query_id, ident).agg(of(0).alias("left_rank"), of(1).alias("right_rank"))
    return both.withColumn("fused", _rrf_part("left_rank", missing_rank, k) + _rrf_part("right_rank", missing_rank, k))


def candidates(limit: int) -> int:
    """How many of each side go on to fusion."""
    return max(4 * limit, 20)


def exact_boost(chunk: dict[str, Column], query: dict[str, Column]) -> Column:
    """Boost for a told article, document, date or citation label."""
    corpus, label = T.normalise_words(chunk["corpus"]), T.normalise_words(chunk["label"])
    article = T.normalise_words(chunk["article"])
    any_in = lambda refs: F.exists(refs, lambda r: corpus.contains(r))
    hit = lambda cond, v: F.when(cond, v).otherwise(0)
    return (
        hit((article != "") & F.array_contains(query["articles"], article), EXACT["article"])
        + hit(any_in(query["documents"]), EXACT["document"]) + hit(any_in(query["dates"]), EXACT["date"])
        + hit((label != "") & query["text"].contains(label), EXACT["label"])
    )


def topical_boost(overlap: Column, rules: list[tuple[Column, float]]) -> Column:
    """1.4 for each of the first four shared topic tokens, and what each rule (condition, boost) adds."""
    out = F.least(overlap, F.lit(4)) * 1.4
    for cond, v in rules:
        out = out + F.when(cond, v).otherwise(0.0)
    return out


def rerank(fused: DataFrame, exact: Column, topical: Column, scope: Column, query_id: str, ident: str, k: int) -> DataFrame:
    score = F.col("fused") + exact * WEIGHTS["exact"] + topical * WEIGHTS["topical"] + scope * WEIGHTS["scope"]
    return ranked(fused.withColumn("rerank_score", score), query_id, ident, k, "rerank_score")


def hybrid(docs: DataFrame, queries: DataFrame, ident: str, text: str, query_id: str, query: str, k: int) -> DataFrame:
    """Lexical and keyword ranks of each query fused; query_id, doc, left_rank, right_rank, fused, rank."""
    scores = term_scores(docs, queries, ident, text, query_id, query)
    fused = rrf_of_scores(scores, query_id, "doc", F.col("score"), F.col("hits"), candidates(k))
    return ranked(fused, query_id, "doc", k, "fused")


def token_hits(docs: DataFrame, queries: DataFrame, ident: str, text: str, query_id: str, query: str, per_token: float = PER_TOKEN) -> DataFrame:
    """Score of documents by distinct query tokens that they hold as words, per_token each."""
    q = queries.select(query_id, F.explode(F.array_distinct(T.tokens(F.col(query)))).alias("term"))
    d = docs.select(F.col(ident).alias("doc"), F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term"))
    return d.join(q, "term").groupBy(query_id, "doc").agg((F.count("*") * per_token).alias("score"))


def keyword_score(haystack: Column, query: Column, toks: Column, whole: float = 10, each: float = 3) -> Column:
    """`whole` if the query is inside, and `each` for every token that is."""
    base = F.when(haystack.contains(query), whole).otherwise(0.0)
    return base + F.aggregate(toks, F.lit(0.0), lambda a, t: a + F.when(haystack.contains(t), each).otherwise(0.0))


def field_score(toks: Column, fields: list[tuple[Column, float]]) -> Column:
    """For every token the weight of each field that contains it (all already normalised)."""
    weigh = lambda t: sum((F.when(c.contains(t), w).otherwise(0.0) for c, w in fields[1:]), F.when(fields[0][0].contains(t), fields[0][1]).otherwise(0.0))
    return F.aggregate(toks, F.lit(0.0), lambda a, t: a + weigh(t))


def phrase_score(question: Column, q_tokens: Column, phrase: Column) -> Column:
    """The number of words of a phrase that stands in the question, plus 3; else one for each shared token."""
    words = F.filter(F.split(T.normalise_words(phrase), " "), lambda w: w != "")
    return F.when((F.size(words) > 0) & question.contains(T.normalise_words(phrase)), F.size(words) + 3).otherwise(F.size(F.array_intersect(words, q_tokens)))


def prefer(df: DataFrame, by: str, wanted: Column) -> DataFrame:
    """Rows of a group that are wanted, or all of them if none is."""
    some = F.max(wanted.cast("int")).over(Window.partitionBy(by))
    return df.withColumn("_some", some).where((F.col("_some") == 0) | wanted).drop("_some")


def all_tokens_present(toks: Column, haystack_tokens: Column) -> Column:
    return F.size(F.array_except(toks, haystack_tokens)) == 0


def assemble(rows: DataFrame, by: str, order: list[str], line: Column, budget: int | None = None) -> DataFrame:
    """by, body: the lines of each group in order, as far as a budget of characters allows."""
    from .relational import fit_budget

    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_l"))
    lines = F.transform("_l", lambda x: x["_line"])
    return g.select(by, F.array_join(fit_budget(lines, budget) if budget else lines, "\n").alias("body"))


def replace_references(text: Column, labels: Column) -> Column:
    """[Rn] becomes the n-th label in brackets; unknown numbers stay."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[R(\d+)\]"), 1))
    step = lambda acc, n: F.when(
        (n.cast("int") >= 1) & (n.cast("int") <= F.size(labels)),
        F.replace(acc, F.concat(F.lit("[R"), n, F.lit("]")), F.concat(F.lit("["), F.try_element_at(labels, n.cast("int")), F.lit("]"))),
    ).otherwise(acc)
    return F.aggregate(marks, text, step)
