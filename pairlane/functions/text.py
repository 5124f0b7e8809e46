"""Scalar text expressions.

All builders return ``Column`` expressions so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode whitespace character; SQL trim
# removes only spaces.  This class reproduces str.strip() on both Spark
# (Java regex) and DuckDB (RE2).
WS_CLASS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]"
STRIP_RE = rf"^{WS_CLASS}+|{WS_CLASS}+$"

# Field markers and description cut used in product text.
TITLE_TAG = "[TITLE]"
BRAND_TAG = "[BRAND]"
DESC_TAG = "[DESC]"
PRICE_TAG = "[PRICE]"
EMPTY_TEXT = "[EMPTY]"
MAX_DESC_CHARS = 300

# Word tokens: runs of two or more word characters (letters, digits, '_').
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"


def _c(col: "str | Column") -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: "str | Column") -> Column:
    """Strip leading/trailing Unicode whitespace like Python's ``str.strip``."""
    return F.regexp_replace(_c(col), STRIP_RE, "")


def clean(col: "str | Column") -> Column:
    """NULL -> '', otherwise stripped string.  The strip regex only runs
    when the first or last character is whitespace (the common case skips
    it)."""
    x = _c(col).cast("string")
    edge = F.substring(x, 1, 1).rlike(WS_CLASS) | F.substring(x, -1, 1).rlike(WS_CLASS)
    return F.coalesce(F.when(edge, F.regexp_replace(x, STRIP_RE, "")).otherwise(x), F.lit(""))


def product_text(title, brand, description, price=None, price_currency=None,
                 include_price: bool = False) -> Column:
    """One text per product side:
    ``[TITLE] t [BRAND] b [DESC] d[:300]`` (+ ``[PRICE] cur p``), missing parts
    omitted, ``[EMPTY]`` when nothing is left.  The description is cut after
    stripping and not stripped again.

    Each cleaned value is computed once: values and tags are zipped and the
    lambda variable is what the emptiness test reads."""
    t, b, d = clean(title), clean(brand), clean(description)
    parts = [t, b, F.substring(d, 1, MAX_DESC_CHARS)]
    tags = [TITLE_TAG, BRAND_TAG, DESC_TAG]
    if include_price:
        p = clean(price) if price is not None else F.lit("")
        pc = clean(price_currency) if price_currency is not None else F.lit("")
        parts.append(F.when(p != "", F.when(pc != "", F.concat(pc, F.lit(" "), p)).otherwise(p))
                     .otherwise(F.lit("")))
        tags.append(PRICE_TAG)
    tagged = F.zip_with(F.array(*[F.lit(g + " ") for g in tags]), F.array(*parts),
                        lambda g, v: F.when(v != "", F.concat(g, v)))
    joined = F.array_join(F.filter(tagged, lambda x: x.isNotNull()), " ")
    return F.regexp_replace(joined, "^$", EMPTY_TEXT)


def side_text(side: str, include_price: bool = False) -> Column:
    """``product_text`` of one side of the unified pair table."""
    return product_text(f"title_{side}", f"brand_{side}", f"description_{side}",
                        f"price_{side}", f"priceCurrency_{side}", include_price)


def negative_cache_key(text: "str | Column", n: "int | Column") -> Column:
    """sha256 hex of ``lower(strip(text)) || '||n=' || n``."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.sha2(F.concat(F.lower(py_strip(_c(text))), F.lit("||n="),
                           n_col.cast("string")), 256)


# ---------------------------------------------------------------- accents ---

# The fold of a text is the fold of its code points one by one: compatibility
# decomposition (NFKD) of each, without what combines.  Reordering only concerns
# combining marks, and those are dropped.

HANGUL = (0xAC00, 0xD7A3)  # syllables: decomposed by arithmetic


def _class(cps: list[int]) -> str:
    """A regex class of ascending code points, as ranges."""
    ranges: list[list[int]] = []
    for cp in cps:
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """From the rule, over all planes: what becomes one character or nothing, for
    ``translate`` (source, and the shorter target: what has no partner in it goes);
    and what becomes several characters, Hangul syllables aside."""
    src, dst, gone, several = [], [], [], {}
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF or HANGUL[0] <= cp <= HANGUL[1]:
            continue
        ch = chr(cp)
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if folded == ch:
            continue
        if not folded:
            gone.append(ch)
        elif len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        else:
            several[ch] = folded
    return "".join(src + gone), "".join(dst), several


def _unfold(ch: Column) -> Column:
    """What a character that becomes several ones becomes; others stay.  The map is
    searched entry by entry, so it is only asked where the class says so."""
    several = _fold_tables()[2]
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    at = F.ascii(ch) - HANGUL[0]  # the code point, in spite of the name

    def jamo(first: int, n: int, i: Column) -> Column:
        return F.substring(F.lit("".join(chr(first + k) for k in range(n))), i + 1, F.lit(1))

    tail = (at % 28).cast("int")
    syllable = F.concat(jamo(0x1100, 19, F.floor(at / 588).cast("int")), jamo(0x1161, 21, F.floor(at % 588 / 28).cast("int")),
                        F.when(tail > 0, jamo(0x11A8, 27, tail - 1)).otherwise(F.lit("")))
    return (F.when(F.ascii(ch) < 0x80, ch).when(F.ascii(ch).between(*HANGUL), syllable)
            .when(ch.rlike(_class(sorted(map(ord, several)))), F.element_at(table, ch)).otherwise(ch))


def fold_accents(col: "str | Column") -> Column:
    """NFKD without combining characters, as column expressions: equal to
    ``unicodedata`` for every code point of every plane."""
    src, dst, several = _fold_tables()
    x = _c(col)
    # ASCII-only text (the common case) skips the tables; few texts hold what becomes several characters.
    # ``translate`` looks characters up, where a regex tries each range of such a class in turn.
    wide = "".join(several) + "".join(map(chr, range(HANGUL[0], HANGUL[1] + 1)))
    spread = F.when(F.length(F.translate(x, wide, "")) < F.length(x),
                    F.array_join(F.transform(F.split(x, ""), _unfold), "")).otherwise(x)
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(spread, src, dst)).otherwise(x)


def word_tokens(col: "str | Column", strip_accents: str | None = "jvm") -> Column:
    """Lowercase, fold accents, extract word tokens (array<string>)."""
    x = F.lower(_c(col))
    if strip_accents == "jvm":
        x = fold_accents(x)
    return F.regexp_extract_all(x, F.lit(TOKEN_RE), 0)


def word_ngrams(tokens: Column, max_n: int = 2) -> Column:
    """Uni- to ``max_n``-grams of a token array, joined by one space."""
    def gram_at(n):
        return lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")

    out = tokens
    for n in range(2, max_n + 1):
        grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), gram_at(n))
        out = F.concat(out, F.when(F.size(tokens) >= n, grams)
                       .otherwise(F.array().cast("array<string>")))
    return out


def char_wb_ngrams(col: "str | Column", min_n: int = 1, max_n: int = 2,
                   strip_accents: str | None = "jvm") -> Column:
    """Character n-grams inside space-padded words (``char_wb`` analyzer).
    A padded word no longer than the smallest n yields itself once; longer
    n-grams come only from words that have them."""
    x = F.lower(_c(col))
    if strip_accents == "jvm":
        x = fold_accents(x)
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    def grams_of(n):
        return lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.length(w) - n, F.lit(0))),
            lambda i: F.substring(w, i + 1, F.lit(n)))

    def long_enough(n):
        return padded if n == min_n else F.filter(padded, lambda w: F.length(w) >= n)

    per_n = [F.flatten(F.transform(long_enough(n), grams_of(n)))
             for n in range(min_n, max_n + 1)]
    return F.concat(*per_n) if len(per_n) > 1 else per_n[0]
