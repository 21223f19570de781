"""Quality of extracted pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: limits, weights and scales of the document score, symbols that count as noise, readable characters, words
LIMITS = {"chars": 260, "readable": 0.72, "abnormal": 0.10, "words": 0.62, "repeated": 0.035, "empty": 0.34, "sparse": 0.5, "confidence": 0.60}
DEFAULT_CONFIDENCE, LOW = 0.75, 0.55
WEIGHTS = {"chars": 0.18, "readable": 0.18, "abnormal": 0.16, "words": 0.16, "repeated": 0.10, "empty": 0.12, "sparse": 0.06, "confidence": 0.04}
WANTED = {"chars": 260, "readable": 0.82, "words": 0.78, "confidence": 0.72}
WORST = {"abnormal": 0.18, "repeated": 0.06}
NOISE = "�□■▪¤¦§©®™`~<>\\"
READABLE = r"[\p{L}\p{N}.,;:!?()\[\]{}%/+\-'’\"«»؀-ۿ]"
WORD = r"[؀-ۿA-Za-zÀ-ÿ0-9][؀-ۿA-Za-zÀ-ÿ0-9'’\-]{1,}"
#: White space as it is counted: that of Unicode and the four separators of ASCII.
SPACE = r"[\s\x1C-\x1F]"


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def page_metrics(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds visible, readable, abnormal, n_tokens, n_words, repeated, n_chars of each page (null text: empty)."""
    c = F.coalesce(F.col(text), F.lit(""))
    noise = "[" + "".join("\\" + ch if ch == "\\" else ch for ch in NOISE) + r"\p{C}]"
    seen = F.regexp_replace(c, f"(?U){SPACE}", "")
    rest = F.regexp_replace(seen, READABLE, "")
    return pages.withColumns({
        "visible": F.length(seen), "readable": _count(seen, READABLE), "abnormal": _count(rest, noise),
        "n_tokens": F.regexp_count(c, F.lit(r"(?U)[^\s\x1C-\x1F]+")), "n_words": F.regexp_count(c, F.lit(WORD)),
        "repeated": F.length(c) - F.length(F.regexp_replace(c, r"([^\n])\1{3,}", "")),
        "n_chars": F.length(F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")),
    })


def _part(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def document_quality(pages: DataFrame, by: str, confidence: str | None = None, low: float = LOW, documents: DataFrame | None = None) -> DataFrame:
    """One row for each document: nine metrics (rounded), score, n_reasons, is_low. Per-page counts are summed
    map-side. Documents (a table with the column `by`) that have no page get score 1, one reason and is_low."""
    conf = F.avg(confidence) if confidence else F.lit(None).cast("double")
    g = page_metrics(pages).groupBy(by).agg(
        F.count("*").alias("p"), *[F.sum(k).alias(k) for k in ("visible", "readable", "abnormal", "n_tokens", "n_words", "repeated", "n_chars")],
        F.count_if(F.col("visible") < 40).alias("empty"), F.count_if((F.col("visible") < 120) | (F.col("n_words") < 15)).alias("sparse"),
        (conf if confidence else F.first(conf)).alias("conf"),
    )
    vis = F.greatest(F.col("visible"), F.lit(1))
    m = g.select(
        by, "p", F.col("conf").isNotNull().alias("told"), (F.col("readable") / vis).alias("readable_ratio"), (F.col("abnormal") / vis).alias("abnormal_symbol_ratio"),
        (F.col("n_words") / F.greatest("n_tokens", F.lit(1))).alias("recognized_word_ratio"), (F.col("repeated") / vis).alias("repeated_char_ratio"),
        (F.col("empty") / F.col("p")).alias("empty_page_ratio"), (F.col("sparse") / F.col("p")).alias("low_density_ratio"),
        F.coalesce("conf", F.lit(DEFAULT_CONFIDENCE)).alias("average_confidence"), (F.col("n_chars") / F.col("p")).alias("chars_per_page"),
        F.col("n_chars").cast("double").alias("total_characters"),
    )
    shown = {
        "chars": "chars_per_page", "readable": "readable_ratio", "abnormal": "abnormal_symbol_ratio", "words": "recognized_word_ratio",
        "repeated": "repeated_char_ratio", "empty": "empty_page_ratio", "sparse": "low_density_ratio", "confidence": "average_confidence",
    }
    x = {k: F.col(c) for k, c in shown.items()}
    reasons = [
        (F.col("p") >= 2) & (x["chars"] < LIMITS["chars"]), x["readable"] < LIMITS["readable"], x["abnormal"] > LIMITS["abnormal"],
        x["words"] < LIMITS["words"], x["repeated"] > LIMITS["repeated"], x["empty"] >= LIMITS["empty"],
        x["sparse"] >= LIMITS["sparse"], F.col("told") & (x["confidence"] < LIMITS["confidence"]),
    ]
    bad = {k: _part((v - x[k]) / v) for k, v in WANTED.items()} | {k: _part(x[k] / v) for k, v in WORST.items()}
    bad |= {k: x[k] for k in ("empty", "sparse")}
    score = sum((F.lit(w) * bad[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    n = sum((r.cast("int") for r in reasons[1:]), reasons[0].cast("int"))
    out = m.withColumns({"score": F.bround(_part(score), 4), "n_reasons": n})
    out = out.withColumns({c: F.bround(c, 2 if c == "chars_per_page" else 4) for c in shown.values()})
    out = out.withColumn("is_low", (F.col("score") >= low) | (F.col("n_reasons") >= 2)).drop("p", "told")
    if documents is None:
        return out
    out = documents.select(by).distinct().join(out, by, "left")
    none = F.col("is_low").isNull()
    return out.withColumns({"score": F.when(none, 1.0).otherwise(F.col("score")), "n_reasons": F.when(none, 1).otherwise(F.col("n_reasons")), "is_low": none | F.col("is_low")})


def rollup_pages(pages: DataFrame, by: str, quality: str = "quality") -> DataFrame:
    """Document quality from page qualities: low if half the pages are, medium if any is less than high."""
    n, low, mid = F.count("*"), F.count_if(F.col(quality) == "low"), F.count_if(F.col(quality) == "medium")
    g = pages.groupBy(by).agg(n.alias("n_pages"), low.alias("n_low"), mid.alias("n_medium"))
    q = F.when(F.col("n_low") * 2 >= F.col("n_pages"), "low").when(F.col("n_low") + F.col("n_medium") > 0, "medium").otherwise("high")
    return g.withColumns({"quality": q, "ratio": F.concat_ws("/", F.col("n_low").cast("string"), F.col("n_pages").cast("string")), "review": q != "high"})


def better_text(native: Column, ocr: Column, native_score: Column, ocr_score: Column, margin: float = 0.05) -> Column:
    """The OCR text where the native one is empty or scores worse by the margin."""
    return F.when((F.length(F.trim(native)) == 0) | (ocr_score > native_score + margin), ocr).otherwise(native)
