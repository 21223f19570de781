from __future__ import annotations

import base64
import hashlib
import hmac
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.vectors import cosine

TEXTS = ["Élan  d'été, N° 5!", "المادة أولى إلى", "Кёльн й Ё", "smile 😀 here", "", None, "a-\nb  c\r\nd\n\n\n\ne", "ΆΝΘΡΩΠΟΣ ñandú", "tab\tand   spaces ", "ạ́ḥ"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def ask(df, column):
    return [r[1] for r in sorted(df.select("i", column.alias("x")).collect())]


def n1(s):
    s = "".join(c for c in unicodedata.normalize("NFD", (s or "").lower()) if not "̀" <= c <= "ͯ")
    s = "".join(c if c.isspace() or unicodedata.category(c)[0] in "LN" else " " for c in s)
    return re.sub(r"\s+", " ", s).strip()


def test_normalise_words(texts):
    have = ask(texts, T.normalise_words(F.col("t")))
    # marks outside U+0300-036F become spaces, as does everything that is no letter or digit
    assert have == [n1(t) for t in TEXTS]


def test_normalise_every_letter(spark):
    letters = [chr(c) for c in range(0xC0, 0x530) if unicodedata.category(chr(c))[0] == "L" and len(chr(c).lower()) == 1]
    df = spark.createDataFrame(list(enumerate(letters)), "i int, t string")
    have = dict(zip(letters, ask(df, T.normalise_words(F.col("t")))))
    assert {c: v for c, v in have.items() if v != n1(c)} == {}


def test_clean_and_tokens(texts):
    cleaned = ask(texts, T.clean(F.col("t")))
    assert cleaned[6] == "ab c\nd\n\ne" and cleaned[5] == "" and cleaned[8] == "tab\tand spaces"
    assert ask(texts, T.tokens(F.col("t")))[0] == ["elan", "ete"]
    assert ask(texts, T.slug(F.col("t")))[0] == "elan-d-ete-n-5"


def test_hashes_and_tokens(spark):
    df = spark.createDataFrame([(0, "hé"), (1, "x" * 200)], "i int, t string")
    for secret in ("k", "long" * 40):
        assert ask(df, T.hmac_sha256(F.col("t"), secret)) == [hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest() for t in ("hé", "x" * 200)]
    want = [base64.urlsafe_b64encode(t.encode()).decode().rstrip("=") for t in ("hé", "x" * 200)]
    assert ask(df, T.base64url(F.col("t"))) == want
    assert ask(df, T.base64url_text(T.base64url(F.col("t")))) == ["hé", "x" * 200]
    token = T.signed_token(F.lit('{"exp": 100}'), "s")
    assert ask(df, T.token_payload(token, "s", 99)) == ['{"exp": 100}'] * 2
    assert ask(df, T.token_payload(token, "s", 100)) == [None] * 2
    assert ask(df, T.token_payload(F.concat(token, F.lit("0")), "s", 1)) == [None] * 2


def test_lists_and_rules(spark):
    df = spark.createDataFrame([(0, "aspirin + ibuprofen, ab; x et warfarin avec digoxin")], "i int, t string")
    assert ask(df, T.split_list(F.col("t"))) == [["aspirin", "ibuprofen", "warfarin", "digoxin"]]
    assert ask(df, T.distinct_texts_ci(F.array(F.lit("A"), F.lit("b"), F.lit("a")))) == [["A", "b"]]
    assert ask(df, T.all_rules(F.col("t"), [("zz", ["q"])], "none")) == [["none"]]
    assert ask(df, T.expand_tokens(F.array(F.lit("a")), F.col("t"), [("warf", ["a", "blood"])])) == [["a", "blood"]]
    for text in ("", "ab", "é漢", "x😀" * 9):
        h = 5381
        units = text.encode("utf-16-be")
        for k in range(0, len(units), 2):
            h = (h * 33 & 0xFFFFFFFF) ^ int.from_bytes(units[k : k + 2], "big")
        assert ask(df, T.xor_hash32(F.lit(text))) == [f"{h:x}"]
    assert ask(df, T.template(F.lit("{a}-{b}"), F.create_map(F.lit("a"), F.lit("1")))) == ["1-{b}"]
    assert ask(df, T.form_values(F.lit("a=1+2&b=%C3%A9"))) == [{"a": "1 2", "b": "é"}]
    assert ask(df, T.phone_address(F.lit("whatsapp:00212 6-1"))) == ["whatsapp:+21261"]


def test_headings(spark):
    df = spark.createDataFrame([(0, "CHAPTER ONE"), (1, "chapitre deux"), (2, "A plain line"), (3, "باب النص"), (4, "Article 3 : x")], "i int, t string")
    assert ask(df, T.looks_like_heading(F.col("t"))) == [True, True, False, True, False]
    assert ask(df, T.starts_article(F.col("t"))) == [False, False, False, False, True]


def test_cosine(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 1.0]), (1, [0.0, 0.0], [1.0, 1.0]), (2, [1.0], [1.0, 1.0])], "i int, a array<double>, b array<double>")
    assert ask(df, F.round(cosine(F.col("a"), F.col("b")), 6)) == [0.707107, 0.0, 0.0]


def test_hash_vector_cycles_one_digest(spark):
    df = spark.createDataFrame([(0, "hé"), (1, "")], "i int, t string")
    want = []
    for t in ("hé", ""):
        digest = hashlib.sha256(t.encode()).digest()
        raw = [digest[k % 32] / 255 * 2 - 1 for k in range(70)]
        size = sum(x * x for x in raw) ** 0.5
        want.append(pytest.approx([x / size for x in raw], abs=6e-7))
    assert ask(df, T.hash_vector(F.col("t"), 70)) == want
    plan = df.select(T.hash_vector(F.col("t"), 70).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1  # one digest of a text, bound outside the loops over its places


def test_clipped_and_plain_text(spark):
    df = spark.createDataFrame([(0, "## A *b* [link](http://x) - c~d\n> e"), (1, None)], "i int, t string")
    assert ask(df, T.strip_markdown(F.col("t"))) == ["A b link c~d e", ""]
    assert ask(df, T.clip(F.lit("abcd efgh"), 6))[0] == "abcd…"
    assert ask(df, T.clip(F.lit("abcd efgh"), 8, "..."))[0] == "abcd ef..."
    assert ask(df, T.clip(F.lit("abcd"), 4, "..."))[0] == "abcd"


def test_languages_by_count(spark):
    texts = ["ا" * 21, "a" * 21, "ا" * 21 + "я" * 21, "ا" * 20 + "a" * 20, "漢" * 50, "é" * 10 + "Ω" * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert ask(df, T.script_language(F.col("t"))) == ["ar", "fr", "mixed", "unknown", "unknown", "fr"]


def test_references_and_keywords(spark):
    df = spark.createDataFrame([(0, "Loi n° 17-04, article 3 et Art. 5; ARTICLE  3 et المادة ٣; décret n 2-9"), (1, None)], "i int, t string")
    assert ask(df, T.cross_references(F.col("t"))) == [["article 3", "ARTICLE 3", "Art. 5", "المادة ٣", "Loi n° 17-04", "décret n 2-9"], []]
    none = F.lit(None).cast("array<string>")
    have = ask(df, T.keyword_set(F.array(F.lit("tax")), none, F.lit("Le Code"), F.lit("TITRE II"), F.lit("4"), F.col("t")))
    assert have[0] == sorted({"tax", "code", "titre", "article 4", "المادة 4", "article", "المادة", "décret"})
    assert have[1] == sorted({"tax", "code", "titre", "article 4", "المادة 4"})
