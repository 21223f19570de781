"""Text functions: Column in, Column out, all inside the JVM (no Python per row)."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- accents and the three normalisers


@cache
def _fold_table() -> tuple[str, str]:
    """Latin, Greek and Cyrillic characters that decompose to one character and marks (or none), and that one."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        d = unicodedata.normalize("NFD", chr(code))
        if d != chr(code) and all(0x300 <= ord(x) <= 0x36F for x in d[1:]):
            source.append(chr(code))
            target.append(d[0])
    return "".join(source), "".join(target)


#: Arabic letters whose decomposition has a mark outside U+0300-036F: base letter, then the mark.
_HAMZA = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0x622, 0x627)}


def strip_marks(c: Column) -> Column:
    """Decompose and drop U+0300-036F."""
    src, dst = _fold_table()
    return F.regexp_replace(F.translate(c, src, dst), "[̀-ͯ]", "")


def letters_and_blanks(c: Column) -> Column:
    """N1 before its blanks are collapsed: lower case, no marks, everything but letters, digits and white space as spaces."""
    x = strip_marks(F.lower(F.coalesce(c, F.lit(""))))
    for letter, parts in _HAMZA.items():
        x = F.replace(x, F.lit(letter), F.lit(parts[0] + " "))  # the mark left over is no letter, so a space
    return F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " ")


def normalise_words(c: Column) -> Column:
    """N1: lower case, no marks, everything but letters and digits to single spaces, trimmed."""
    return F.trim(F.regexp_replace(letters_and_blanks(c), r"\s+", " "))


def normalise_text(c: Column) -> Column:
    """N2: lower case, no marks, trimmed, white space collapsed; punctuation stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_marks(F.coalesce(c, F.lit("")))), r"^\s+|\s+$", ""), r"\s+", " ")


def normalise_search(c: Column) -> Column:
    """N3: as N2 without collapsing."""
    return F.regexp_replace(F.lower(strip_marks(F.coalesce(c, F.lit("")))), r"^\s+|\s+$", "")


# ---------------------------------------------------------------- tokens


def tokens(c: Column) -> Column:
    """Words of N1 longer than one character."""
    return F.filter(F.split(normalise_words(c), " "), lambda t: F.length(t) > 1)


def ascii_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_]+"), lambda t: t != "")


def unicode_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)[\wÀ-ÿ؀-ۿ]{2,}"), 0)


# fixed value
#: A word: a letter or digit (Latin, Arabic), then at least one more letter, digit, apostrophe or hyphen.
WORD = r"[؀-ۿA-Za-zÀ-ÿ0-9][؀-ۿA-Za-zÀ-ÿ0-9'’\-]{1,}"


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0))


def topical_tokens(ts: Column, stopwords: list[str]) -> Column:
    """Distinct tokens longer than two characters that are no stop words."""
    return F.array_distinct(F.filter(ts, lambda t: (F.length(t) > 2) & ~t.isin(stopwords)))


def expand_tokens(ts: Column, c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Tokens, then those that each rule (pattern on N1, additions) adds."""
    n = normalise_words(c)
    none = F.array().cast("array<string>")
    more = [F.when(n.rlike(p), F.array(*[F.lit(a) for a in add])).otherwise(none) for p, add in rules]
    return F.array_distinct(F.concat(ts, *more))


# ---------------------------------------------------------------- cleaning and shaping


def clean(c: Column, newlines: bool = True) -> Column:
    """Remove NUL and BOM, unify line ends and spaces, join words hyphenated at a line end."""
    x = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit("")), F.lit("﻿"), F.lit(""))
    x = F.regexp_replace(x, r"\r\n?", "\n")
    x = F.translate(x, " ", " ")
    x = F.regexp_replace(x, r"([A-Za-zÀ-ÿ])-\n([A-Za-zÀ-ÿ])", "$1$2")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"[ \t]{2,}", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n") if newlines else F.regexp_replace(F.translate(x, "\n", " "), r"[ \t]{2,}", " ")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def tidy(c: Column) -> Column:
    """No-break spaces to spaces, direction marks out, runs of blanks to one, at most one empty line."""
    x = F.regexp_replace(F.translate(c, " ", " "), "[‎‏]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def one_line(c: Column, size: int | None = None) -> Column:
    x = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s&&[^ ]]\s*| \s+", " "))  # single blanks stay
    return x if size is None else F.substring(x, 1, size)


def many_lines(c: Column, size: int) -> Column:
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(x, r"^\s+|\s+$", ""), 1, size)


def clip(c: Column, size: int, mark: str = "…") -> Column:
    """Texts of more than `size` characters: the first size - 1, trimmed, and the mark (whatever its length)."""
    return F.when(F.length(c) > size, F.concat(F.trim(F.substring(c, 1, size - 1)), F.lit(mark))).otherwise(c)


def slug(c: Column, joiner: str = "-", keep_arabic: bool = False) -> Column:
    letters = "0-9a-z؀-ۿ" if keep_arabic else "0-9a-z"
    x = F.regexp_replace(F.lower(strip_marks(F.coalesce(c, F.lit("")))), f"[^{letters}]+", joiner)
    return F.regexp_replace(x, f"^{joiner}+|{joiner}+$", "")


def strip_markdown(c: Column) -> Column:
    """Runs of emphasis, code, heading, quote and list marks become a space, then links their text."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"[*_`#>-]+", " ")
    x = F.regexp_replace(x, r"\[([^\n\r]*?)\]\([^\n\r]*?\)", "$1")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def html_escape(c: Column) -> Column:
    x = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strip_tags(c: Column) -> Column:
    x = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " "))


def arabic_digits(c: Column) -> Column:
    return F.translate(c, "".join(chr(0x660 + i) for i in range(10)), "0123456789")


def split_list(c: Column) -> Column:
    """Items of a list written with + / , ; or the words for and / with; at least three characters."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?i)[+/,;]|\s+et\s+|\s+avec\s+")
    return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda x: F.length(x) >= 3)


def split_keywords(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda v: F.trim(v)), lambda x: x != "")


def distinct_texts(values: Column) -> Column:
    """Trimmed, non-empty, first of equals (order kept)."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda x: x.isNotNull() & (x != "")))


def distinct_texts_ci(values: Column) -> Column:
    """First of those equal but for case, in order."""
    low = F.transform(values, lambda x: F.lower(x))
    return F.filter(values, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def sentences(c: Column) -> Column:
    return tidy_sentences(tidy(F.coalesce(c, F.lit(""))))


def tidy_sentences(c: Column) -> Column:
    """Sentences of a text that tidy() has made."""
    parts = F.split(c, r"(?<=[.!؟?;])\s+|\n+")
    return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda x: x != "")


#: What patterns that ignore case take for i or s besides these letters, as lower() leaves it.
_ODD_CASE = ("ı", "ſ", "\u0307")


def odd_case(low: Column) -> Column:
    """Whether a text in lower case has letters by which patterns that ignore case match what its lower case does not show."""
    return reduce(lambda a, b: a | b, [low.contains(x) for x in _ODD_CASE])


def _holds(low: Column, literals: list[str]) -> Column:
    return F.lit(True) if "" in literals else reduce(lambda a, b: a | b, [low.contains(x) for x in literals])


def _literals(patterns: list[str]) -> list[str]:
    """Of each pattern what its matches must hold; the empty string where it is not plain text between word ends."""
    plain = [p.replace(r"\b", "") for p in patterns]
    return [x.lower() if x.replace(" ", "").isalnum() else "" for x in plain]


def marked_lines(lines: Column, low: Column, odd: Column, patterns: list[str], most: int = 3) -> Column:
    """The first of some lines (text, low: in lower case) that match any pattern, clipped to 400 characters. low is the lower case of
    the text that has the lines, odd its odd_case(): patterns are asked only where the text, and then the line, holds what they need."""
    any_of, need = "(?iU)" + "|".join(f"(?:{p})" for p in patterns), _literals(patterns)
    found = F.transform(F.filter(lines, lambda x: (odd | _holds(x["low"], need)) & x["low"].rlike(any_of)), lambda x: F.substring(x["text"], 1, 400))
    return F.when(odd | _holds(low, need), F.slice(found, 1, most)).otherwise(F.array().cast("array<string>"))


def with_low(lines: Column) -> Column:
    return F.transform(lines, lambda s: F.struct(s.alias("text"), F.lower(s).alias("low")))


def key_lines(c: Column, patterns: list[str], most: int = 3) -> Column:
    """The first sentences that match any pattern, clipped to 400 characters."""
    return _once(tidy(F.coalesce(c, F.lit(""))), lambda x: _once(F.lower(x), lambda low: marked_lines(with_low(tidy_sentences(x)), low, odd_case(low), patterns, most)))


def find_all(c: Column, patterns: list[tuple[str, int]], most: int | None = None, shape=tidy, need: list[str] | None = None, low: Column | None = None, odd: Column | None = None) -> Column:
    """Distinct matches, in order of pattern, then place; each pattern comes with its group. With need, a literal (in lower case) that
    the matches of each pattern hold, and low and odd as for marked_lines(), only what may match is asked."""
    text, none = F.coalesce(c, F.lit("")), F.array().cast("array<string>")
    every = [F.regexp_extract_all(text, F.lit(p), g) for p, g in patterns]
    if need:
        every = [F.when(odd | _holds(low, [x]), e).otherwise(none) for x, e in zip(need, every, strict=True)]
    out = F.array_distinct(F.filter(F.transform(F.concat(*every), shape), lambda x: x != ""))
    return out if most is None else F.slice(out, 1, most)


# fixed values: letters of a keyword, references of one text to another
LETTERS = "[A-Za-zÀ-ÿ؀-ۿ]"
CROSS_REFERENCES = [
    r"article\s+(premier|1er|\d+)",
    r"art\.\s*(premier|1er|\d+)",
    r"المادة\s+([0-9٠-٩]+)",
    r"loi\s+n[°º]?\s*[\d\.-]+",
    r"dahir\s+n[°º]?\s*[\d\.-]+",
    r"décret\s+n[°º]?\s*[\d\.-]+",
    r"مرسوم\s+رقم\s+[\d\.-]+",
    r"ظهير\s+شريف\s+رقم\s+[\d\.-]+",
]
CROSS_NEED = ["article", "art.", "المادة", "loi", "dahir", "décret", "مرسوم", "ظهير"]


def cross_references(c: Column, most: int = 20, low: Column | None = None, odd: Column | None = None) -> Column:
    """Distinct references to articles and laws, in order of pattern, then place."""
    return find_all(c, [("(?iu)" + p, 0) for p in CROSS_REFERENCES], most, need=None if low is None else CROSS_NEED, low=low, odd=odd)


def keyword_set(topics: Column, translated: Column, title: Column, path: Column, article: Column, text: Column, most: int = 30) -> Column:
    """Sorted keywords of at most 80 characters: topics and their translations, letter runs of three and more of
    title and path, of four and more of the first 300 characters of the text, and the article by two names."""
    none = F.array().cast("array<string>")
    runs = lambda c, n: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"{LETTERS}{{{n},}}"), 0), lambda x: F.lower(x))
    named = F.when(article != "", F.array(F.concat(F.lit("article "), article), F.concat(F.lit("المادة "), article))).otherwise(none)
    every = F.concat(F.coalesce(topics, none), F.coalesce(translated, none), runs(title, 3), runs(path, 3), named, runs(F.substring(text, 1, 300), 4))
    return F.slice(F.array_sort(F.array_distinct(F.filter(every, lambda k: k.isNotNull() & (k != "") & (F.length(k) <= 80)))), 1, most)


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose text c contains."""
    out = F.lit(default)
    for needle, label in reversed(rules):
        out = F.when(c.contains(needle), F.lit(label)).otherwise(out)
    return out


def all_rules(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Labels of all rules whose text c contains, in order; the default if there are none."""
    none = F.array().cast("array<string>")
    got = F.array_distinct(F.concat(*[F.when(c.contains(n), F.array(*[F.lit(x) for x in ls])).otherwise(none) for n, ls in rules]))
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(default)))


def first_match(c: Column, patterns: list[tuple[str, int]]) -> Column:
    """Match of the first pattern that matches, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, g), F.lit("")) for p, g in patterns])


# ---------------------------------------------------------------- language


def script_language(c: Column, least: int = 20) -> Column:
    """ar, fr, mixed or unknown: more than `least` Arabic characters, letters before them in Unicode, both, none."""
    more = lambda chars: c.rlike(rf"(?s)^(?>.*?{chars}){{{least + 1}}}")  # noqa: E731  # reads no further than needed
    ar, la = more(r"[\x{0600}-\x{06FF}]"), more(r"[\p{L}&&[\x{0000}-\x{05FF}]]")
    return F.when(ar & la, "mixed").when(ar, "ar").when(la, "fr").otherwise("unknown")


def letter_language(c: Column, spanish_first: bool = True) -> Column:
    """ar, es, ru or fr by the first telling letter that occurs; es and ru are asked in either order."""
    es, ru = c.rlike("(?i)[ñ¿¡]"), c.rlike("[Ѐ-ӿ]")
    out = F.when(c.rlike("[؀-ۿ]"), "ar")
    out = out.when(es, "es").when(ru, "ru") if spanish_first else out.when(ru, "ru").when(es, "es")
    return out.otherwise("fr")


# ---------------------------------------------------------------- ids, hashes, encodings


def phone_address(c: Column) -> Column:
    """whatsapp:+digits, or null without digits; a leading 00 is a plus."""
    raw = F.regexp_replace(F.lower(F.trim(c)), "^whatsapp:", "")
    digits = F.regexp_replace(F.regexp_replace(raw, "[^0-9]", ""), "^00", "")
    return F.when(digits != "", F.concat(F.lit("whatsapp:+"), digits))


def phone_key(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9+]", "")


def short_hash(c: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, size)


def _padded_key(secret: str) -> tuple[bytes, bytes]:
    import hashlib

    k = secret.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha256(c: Column, secret: str) -> Column:
    """HMAC-SHA-256 in hex, as two nested hashes over binary."""
    inner, outer = _padded_key(secret)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", ""), "+/=", "-_ "))


def base64url_text(c: Column) -> Column:
    x = F.translate(c, "-_", "+/")
    return F.decode(F.unbase64(F.concat(x, F.repeat(F.lit("="), F.pmod(-F.length(x), F.lit(4))))), "UTF-8")


def signed_token(payload: Column, secret: str) -> Column:
    body = base64url(payload)
    return F.concat(body, F.lit("."), hmac_sha256(body, secret))


def token_payload(token: Column, secret: str, now: int) -> Column:
    """The payload of a token whose signature holds and whose `exp` is not past, else null."""
    body, sign = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
    text = base64url_text(body)
    fresh = F.get_json_object(text, "$.exp").cast("long") > now
    return F.when((sign == hmac_sha256(body, secret)) & fresh, text)


def xor_hash32(c: Column) -> Column:
    """Hash of a string in hex: h = (h * 33) xor code, in 32 bits, from 5381, over its UTF-16 units."""
    units = F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-16BE"))
    codes = F.transform(F.filter(F.split(F.regexp_replace(units, "(.{4})", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, x: F.pmod(h * 33, F.lit(1 << 32)).bitwiseXOR(x))
    return F.lower(F.hex(h))


def _once(c: Column, f) -> Column:
    """f of a value that is evaluated once for each row, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def hash_vector(c: Column, size: int = 64) -> Column:
    """Deterministic unit vector: the bytes of the SHA-256 digest, over and over, as numbers from -1 to 1; six places."""
    digit = lambda digest, i: F.ascii(F.substring(digest, i + 1, 1)) % 39 - 9  # of 0-9 and a-f
    byte = lambda digest, i: digit(digest, 2 * i) * 16 + digit(digest, 2 * i + 1)
    values = lambda digest: F.array(*(byte(digest, i).cast("double") / 255.0 * 2.0 - 1.0 for i in range(min(size, 32))))
    raw = lambda digest: values(digest) if size <= 32 else F.slice(F.flatten(F.array_repeat(values(digest), -(-size // 32))), 1, size)
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda r: _once(norm(r), lambda n: F.transform(r, lambda x: F.round(x / n, 6)))
    return _once(F.sha2(c, 256), lambda digest: _once(raw(digest), unit))


def date_label(c: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "dd/MM/yyyy"), c)


def template(text: Column, values: Column) -> Column:
    """Replace {key} by the value of each entry of a map."""
    return F.aggregate(F.map_entries(values), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def form_values(c: Column) -> Column:
    """Map of an url-encoded form."""
    pairs = F.filter(F.split(F.coalesce(c, F.lit("")), "&"), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(
        F.url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), F.url_decode(F.split_part(p, F.lit("="), F.lit(2))).alias("value"))))


def as_flag(c: Column) -> Column:
    """True for the written forms of yes."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def one_of(c: Column, allowed: list[str], default: str) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin(allowed), x).otherwise(F.lit(default))


def is_fresh(at: Column, now: Column, seconds: int) -> Column:
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(at) < seconds, F.lit(False))


def labelled_text(*parts: tuple[str | None, Column], most: int | None = None) -> Column:
    """Lines `Label: value` (or the value alone) of the parts that are not blank, equal lines once."""
    lines = [F.when(F.trim(c) != "", c if label is None else F.concat(F.lit(f"{label}: "), c)) for label, c in parts]
    out = F.array_join(distinct_texts(F.array(*lines)), "\n")
    return out if most is None else F.substring(out, 1, most)


def citation_label(title: Column, section: Column, article: Column, first: Column, last: Column) -> Column:
    """Title, section, article and pages, joined by dashes."""
    pages = F.when(first.isNotNull(), F.when(last.isNotNull() & (last != first), F.concat(F.lit("p. "), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit("p. "), first.cast("string"))))
    return F.array_join(distinct_texts(F.array(title, section, F.concat(F.lit("art. "), article), pages)), " — ")


def looks_like_heading(c: Column) -> Column:
    """At most twelve words, and all upper case or opened by a structure word."""
    flat = one_line(c)
    upper = (F.upper(flat) == flat) & (F.lower(flat) != flat)
    blanks = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return (blanks < 12) & (upper | flat.rlike(r"(?iU)^(chapitre|section|titre|annexe|partie|livre|باب|قسم|ملحق)\b"))


def starts_article(c: Column) -> Column:
    return one_line(c).rlike(r"(?iU)^(article|art\.?|المادة|الفصل)\b")


def rewrite_headings(c: Column, aliases: list[tuple[list[str], str]]) -> Column:
    """Each alias that opens a line, and that a colon or the line's end follows, becomes its target."""
    out = F.coalesce(c, F.lit(""))
    for names, target in aliases:
        for name in names:
            out = F.regexp_replace(out, rf"(?miU)^\Q{name}\E(?=\s*:|\s*$)", target.replace("\\", r"\\").replace("$", r"\$"))
    return out
