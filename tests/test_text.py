"""Product text, trimming, cache keys and tokens (cases follow the
reference's product-text tests)."""

import hashlib

from pyspark.sql import functions as F

from pairlane.functions import text as tx


def _text(spark, title, brand, desc, price=None, cur=None, include_price=False):
    df = spark.createDataFrame([(title, brand, desc, price, cur)],
                               "t string, b string, d string, p string, c string")
    return df.select(tx.product_text("t", "b", "d", "p", "c", include_price).alias("x")).first()["x"]


def test_all_fields(spark):
    assert _text(spark, "Dell XPS 13", "Dell", "13-inch laptop") == \
        "[TITLE] Dell XPS 13 [BRAND] Dell [DESC] 13-inch laptop"


def test_missing_brand(spark):
    assert _text(spark, "Dell XPS 13", None, "laptop") == "[TITLE] Dell XPS 13 [DESC] laptop"


def test_description_cut_after_strip(spark):
    d = "  " + "x" * 350
    out = _text(spark, "T", None, d)
    assert out == "[TITLE] T [DESC] " + "x" * 300


def test_nothing_is_empty(spark):
    assert _text(spark, None, None, None) == "[EMPTY]"
    assert _text(spark, "", "  ", "\t") == "[EMPTY]"


def test_title_only(spark):
    assert _text(spark, "  Only title ", None, None) == "[TITLE] Only title"


def test_price(spark):
    assert _text(spark, "T", None, None, "9.99", "EUR", True) == "[TITLE] T [PRICE] EUR 9.99"
    assert _text(spark, "T", None, None, "9.99", None, True) == "[TITLE] T [PRICE] 9.99"
    assert _text(spark, "T", None, None, None, "EUR", True) == "[TITLE] T"


def test_unicode_strip_matches_python(spark):
    for ch in ["\u000b", "\u001c", "\u001f", "\u0085", " ", " ", "　", " \t\n"]:
        s = f"{ch}abc{ch}"
        got = spark.createDataFrame([(s,)], "s string").select(tx.py_strip("s").alias("x")).first()["x"]
        assert got == s.strip(), repr(ch)


def test_cache_key_matches_hashlib(spark):
    text = "  [TITLE] Foo BAR 12 "
    got = spark.createDataFrame([(text,)], "t string").select(
        tx.negative_cache_key("t", 5).alias("k")).first()["k"]
    assert got == hashlib.sha256(f"{text.strip().lower()}||n=5".encode()).hexdigest()


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("[TITLE] Héllo  wörld a café_2",)], "t string")
    toks = df.select(tx.word_tokens("t").alias("x")).first()["x"]
    assert toks == ["title", "hello", "world", "cafe_2"]
    grams = df.select(tx.word_ngrams(tx.word_tokens("t")).alias("x")).first()["x"]
    assert grams[-3:] == ["title hello", "hello world", "world cafe_2"]


def test_char_wb(spark):
    df = spark.createDataFrame([("ab c",)], "t string")
    got = df.select(tx.char_wb_ngrams("t", 2, 3).alias("x")).first()["x"]
    # ' ab ' -> ' a','ab','b ' ; ' c ' -> ' c','c ' ; n=3: ' ab','ab ' ; ' c ' once
    assert sorted(got) == sorted([" a", "ab", "b ", " c", "c ", " ab", "ab ", " c "])


def test_fold_equals_unicodedata_for_every_code_point(spark):
    import unicodedata
    from pyspark.sql import functions as F
    from pairlane.functions.text import fold_accents

    def want(x):
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    chars = [chr(cp) for cp in range(1, 0x110000) if not 0xD800 <= cp <= 0xDFFF]
    step = 64  # neighbours share a text, with an ASCII letter between them
    texts = ["x".join(chars[k:k + step]) for k in range(0, len(chars), step)]
    texts += ["", "ﬁne ½ ½", "ẹ́ ṩ", "한글 各 한", "ﷺ!", "𝔘𝔫𝔦 ㎏ ǆ"]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", fold_accents("t").alias("f")).collect()
    assert len(got) == len(texts)
    bad = [(r.i, texts[r.i], r.f) for r in got if r.f != want(texts[r.i])]
    assert not bad, bad[:3]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(fold_accents("t")).first()[0] is None
