"""Rerank of fused candidates by features of question and chunk.

Only candidates (query, chunk) meet. Features of a chunk are made for its candidates, so chunks that nobody asks for cost
nothing but the join; those of a question once for each question. Rules are a table: what the question asks about, what the chunk is, how many topic tokens they
share at least and at most, and the boost.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

from .retrieval import EXACT, WEIGHTS, ranked

# fixed values: patterns of references, told articles first
ARTICLES = [(r"(?i)\barticle\s+(premier|1er|\d+)\b", 1), (r"(?i)\bart\.?\s*(premier|1er|\d+)\b", 1), (r"المادة\s+([0-9٠-٩]+)", 1)]
DOCUMENTS = [(r"(?iu)\b(?:loi|dahir|decret|décret|arrete|arrêté)\s*(?:n[°º]?\s*)?[\d.-]+", 0), (r"(?i)\bbo[\s_:-]*\d+", 0), (r"مرسوم\s+رقم\s+[\d.-]+", 0), (r"ظهير(?:\s+شريف)?\s+رقم\s+[\d.-]+", 0)]
DATES = [(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 0), (r"(?i)\b\d{1,2}\s+[a-z؀-ۿ]+\s+\d{4}\b", 0)]
# fixed values: weights of the topical boost
PER_TOPIC, MOST_TOPICS, PER_ID_TOKEN = 1.4, 4, 1.5
LANGUAGE, CONFIDENCE, REVIEW = {"ar": 1.0, "fr": 0.5}, {"high": 1.0, "medium": 0.4, "low": -0.5}, -1.0
AUTHORITY = {"other": -1.0, "review": -0.5, "else": 1.0}
SCOPES = {"regulations": -1.5, "compliance": -0.2}


class Boost(NamedTuple):
    """boost if the question has an `asks` mark (and not `but_not`), the chunk is of one of the types (none: any), its
    column `has` is a list with entries, its titles match `about`, and from `least` to `most` topic tokens are shared."""

    asks: str
    boost: float
    types: tuple[str, ...] = ()
    has: str | None = None
    about: str | None = None
    but_not: str | None = None
    least: int = 0
    most: int = 1 << 30


class Rules(NamedTuple):
    #: mark -> pattern on the question's topic tokens (joined by blanks)
    marks: dict[str, str]
    boosts: tuple[Boost, ...]
    stopwords: tuple[str, ...]


# neutral examples: marks and words; the boosts are fixed values
RULES = Rules(
    {"equivalence": r"\b(equival|diplom)", "permit": r"autoris|exerc", "sanctions": r"\b(sanction|amende)", "deadlines": r"\b(delai|echeance)", "obligations": r"\b(obligation|doit)", "practical": r"\b(comment|faire|preparer)"},
    (
        Boost("equivalence", 1.5, ("decret", "loi", "arrete"), least=2), Boost("equivalence", -1.5, ("guide_pratique",), about="autorisation|exercice", but_not="permit"),
        Boost("sanctions", 2.0, has="sanctions"), Boost("deadlines", 2.0, has="deadlines"), Boost("obligations", 2.0, has="obligations"),
        Boost("practical", 5.0, ("guide_pratique",), least=2), Boost("practical", 1.0, ("guide_pratique",), least=1, most=1), Boost("practical", -1.0, ("guide_pratique",), most=0),
    ),
    ("les", "des", "une", "que", "the", "and"),
)
_ARABIC = r"[؀-ۿ]"


def _joined(columns: list[Column]) -> Column:
    return F.concat_ws(" ", *columns)


def _listed(name: str, df: DataFrame) -> Column:
    return F.col(name) if name in df.columns else F.array().cast("array<string>")


def _told(name: str, df: DataFrame, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def chunk_features(chunks: DataFrame, ident: str, rules: Rules = RULES, *kept: str) -> DataFrame:
    """doc, what rules look at, and columns that are kept. Columns that chunks lack count as null; chunks: official_title, short_title, citation_label,
    structure_path, section_path, article_number, document_type, source_document_kind, language, confidence,
    manual_review_required, legal_summary, and the lists citations (or cross_references), topics, topic_tags, retrieval_keywords,
    keywords, user_questions, sanctions, deadlines, obligations."""
    t, a = (lambda n: _told(n, chunks)), (lambda n: _listed(n, chunks))
    refs = F.coalesce(a("citations") if "citations" in chunks.columns else F.lit(None).cast("array<string>"), a("cross_references"))
    titles = [t("official_title"), t("short_title")]
    corpus = T.normalise_words(_joined([*titles, t("citation_label"), t("structure_path"), t("section_path"), refs]))
    topical = _joined([F.col(ident).cast("string"), *titles, t("citation_label"), t("section_path"), t("structure_path"), *(a(c) for c in ("topics", "topic_tags", "retrieval_keywords", "keywords", "user_questions")), t("legal_summary")])
    review = F.coalesce(_told("manual_review_required", chunks, "boolean"), F.lit(False))
    other = (F.coalesce(t("document_type"), F.lit("")) == "autre") | (F.coalesce(t("source_document_kind"), F.lit("")) == "knowledge_markdown")
    authority = F.when(other, AUTHORITY["other"]).when(review, AUTHORITY["review"]).otherwise(AUTHORITY["else"])
    confidence = reduce(lambda w, kv: w.when(t("confidence") == kv[0], kv[1]), CONFIDENCE.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return chunks.select(
        F.col(ident).alias("doc"), corpus.alias("c_corpus"), T.normalise_words(t("article_number")).alias("c_article"), T.normalise_words(t("citation_label")).alias("c_label"),
        T.topical_tokens(T.tokens(topical), list(rules.stopwords)).alias("c_topics"), T.normalise_words(_joined([*titles, a("topics"), a("topic_tags")])).alias("c_titles"),
        F.coalesce(t("document_type"), F.lit("")).alias("c_type"), F.coalesce(t("language"), F.lit("")).alias("c_language"), T.tokens(F.col(ident).cast("string")).alias("c_id"),
        (confidence + F.when(review, REVIEW).otherwise(0.0) + authority).alias("c_standing"),
        *(F.coalesce(F.size(a(c)) > 0, F.lit(False)).alias(f"c_{c}") for c in sorted({b.has for b in rules.boosts if b.has})), *kept,
    )


def question_features(questions: DataFrame, query_id: str, question: str, rules: Rules = RULES) -> DataFrame:
    """query_id and what rules look at: references, topic tokens, marks."""
    q, n = F.coalesce(F.col(question), F.lit("")), T.normalise_words(F.col(question))
    refs = lambda patterns: F.filter(F.array_distinct(F.transform(T.find_all(q, patterns, 1000), T.normalise_words)), lambda r: r != "")
    out = questions.select(query_id, q.alias("q_text"), n.alias("q_norm"), T.topical_tokens(T.tokens(F.col(question)), list(rules.stopwords)).alias("q_topics"),
                           refs(ARTICLES).alias("q_articles"), refs(DOCUMENTS).alias("q_documents"), refs(DATES).alias("q_dates"))
    line = F.array_join("q_topics", " ")
    return out.withColumns({f"q_{m}": line.rlike(p) for m, p in rules.marks.items()})


def exact_boost() -> Column:
    within = lambda refs: F.exists(refs, lambda r: F.col("c_corpus").contains(r))
    hit = lambda cond, v: F.when(cond, float(v)).otherwise(0.0)
    return (hit((F.col("c_article") != "") & F.array_contains("q_articles", F.col("c_article")), EXACT["article"]) + hit(within("q_documents"), EXACT["document"])
            + hit(within("q_dates"), EXACT["date"]) + hit((F.col("c_label") != "") & F.col("q_norm").contains(F.col("c_label")), EXACT["label"]))


def topical_boost(rules: Rules = RULES) -> Column:
    shared = F.size(F.array_intersect("q_topics", "c_topics"))
    out = F.least(shared, F.lit(MOST_TOPICS)) * PER_TOPIC + F.col("c_standing")
    for b in rules.boosts:
        fits = F.col(f"q_{b.asks}") & shared.between(b.least, b.most)
        fits = fits & F.col("c_type").isin(*b.types) if b.types else fits
        fits = fits & F.col(f"c_{b.has}") if b.has else fits
        fits = fits & F.col("c_titles").rlike(b.about) if b.about else fits
        fits = fits & ~F.col(f"q_{b.but_not}") if b.but_not else fits
        out = out + F.when(fits, b.boost).otherwise(0.0)
    in_id = F.size(F.filter("c_id", lambda w: F.array_contains("q_topics", w)))
    arabic = F.col("q_text").rlike(_ARABIC)
    return (out + F.when(in_id >= 2, in_id * PER_ID_TOKEN).otherwise(0.0) + F.when((F.col("c_language") == "ar") & arabic, LANGUAGE["ar"]).otherwise(0.0)
            + F.when((F.col("c_language") == "fr") & ~arabic, LANGUAGE["fr"]).otherwise(0.0))


def scope_boost(scope: str | None) -> Column:
    told = SCOPES.get((scope or "").strip().lower())
    return F.when(F.col("c_type") == "autre", told).otherwise(0.0) if told else F.lit(0.0)


def rerank(fused: DataFrame, chunks: DataFrame, questions: DataFrame, ident: str, query_id: str, question: str, k: int, scope: str | None = None, rules: Rules = RULES) -> DataFrame:
    """fused (query_id, doc, fused) with exact, topical, rerank_score and rank of the k best of each query."""
    told = fused.select(F.col("doc").alias("_doc"), F.struct(*fused.columns).alias("_fused")).join(chunks, F.col("_doc") == F.col(ident))
    both = chunk_features(told, ident, rules, "_fused").drop("doc").select("_fused.*", "*").drop("_fused").join(question_features(questions, query_id, question, rules), query_id)
    both = both.withColumns({"exact": exact_boost(), "topical": topical_boost(rules), "scope": scope_boost(scope)})
    score = F.col("fused") + F.col("exact") * WEIGHTS["exact"] + F.col("topical") * WEIGHTS["topical"] + F.col("scope") * WEIGHTS["scope"]
    return ranked(both.select(*fused.columns, "exact", "topical", "scope", F.round(score, 9).alias("rerank_score")), query_id, "doc", k, "rerank_score")
