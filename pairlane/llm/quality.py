"""Quality rules: a threshold table compiled into Spark projections.

Every feature is a built-in expression over the words and lines of the whole
text, every rule a bound on one feature; no user function runs and no row moves.
A null text has no words.  The table is judged in one pass and the first rule
that a text breaks is named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: word class, symbol class, window, base bounds.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

#: Function words of the four languages.
STOP_WORDS = ("the of and to in is that it for was on are as with at by this from have be not "
              "le la les de des et un une en que qui dans pour sur par est du au avec "
              "der die das und den von zu mit sich auf dem ein eine nicht im als auch "
              "el los las del y una se por con para su al lo es como").split()


@dataclass(frozen=True)
class Rule:
    name: str
    feature: str           # SQL over the feature columns
    low: float | None
    high: float | None
    min_words: int = 0     # shorter texts are not judged by this rule


#: The threshold table.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 25.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.25),
    Rule("shouting_ratio", "n_marks / n_words", None, 0.3),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.005, None, 60),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9),
)


def base_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the words, lines and counts of the contract as ``pl_*``
    columns.  Repeated windows are found by sorting their hashes within the
    text, and only where there is one at all."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    w, h, s = F.col("pl_words"), F.col("pl_hashes"), F.col("pl_sorted")
    df = df.withColumns({
        "pl_words": F.array_remove(F.split(t, SPACE), ""),
        "pl_lines": F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        "n_symbols": F.length(F.regexp_replace(t, NOT_SYMBOL, "")).cast("long"),
        "n_marks": F.length(F.regexp_replace(t, r"[^!?]+", "")).cast("long"),
    })
    window = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                         lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "pl_hashes": F.when(F.size(w) >= WINDOW, window).otherwise(F.array().cast("array<bigint>")),
        "n_lines": F.size("pl_lines").cast("long"),
        "n_dup_lines": (F.size("pl_lines") - F.size(F.array_distinct("pl_lines"))).cast("long"),
    })
    df = df.withColumn("pl_sorted", F.when(
        F.size(F.array_distinct(h)) < F.size(h),
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
    df = df.withColumn("pl_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "pl_places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def compiled(rules=RULES) -> Column:
    """Name of the first rule that a row breaks, null if none: one expression
    for the whole table."""
    expr = F.lit(None).cast("string")
    for rule in reversed(rules):
        value = F.expr(f"CASE WHEN n_words > 0 AND n_lines > 0 THEN {rule.feature} END")
        out = F.lit(False)
        if rule.low is not None:
            out = out | (value < rule.low)
        if rule.high is not None:
            out = out | (value > rule.high)
        expr = F.when(F.coalesce(out, F.lit(False)) & (F.col("n_words") >= rule.min_words),
                      F.lit(rule.name)).otherwise(expr)
    return expr


def features(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` (with a ``text``) and every feature, ``base_failed`` and the broken
    ``rule``; a null or empty text has no words and fails the base."""
    df = base_features(df)
    stop = sorted(set(STOP_WORDS))
    lines = F.col("pl_lines")
    df = df.withColumns({
        "n_stop_words": F.size(F.filter("pl_words", lambda w: F.lower(w).isin(*stop))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*\u2022]\x20"))).cast("long"),
    })
    return df.withColumns({"base_failed": base_failed(), "rule": compiled(rules)})


def passes() -> Column:
    """The verdict.  The row number (never negative) keeps a filter on it above
    the feature projections; pushed below them it would repeat their expressions
    for every use."""
    return ~F.col("base_failed") & F.col("rule").isNull() & (F.monotonically_increasing_id() >= 0)


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """The counts, ``base_failed``, the broken ``rule`` and ``kept`` of every row
    of ``docs`` (``doc_id`` and ``text``; other columns are not read)."""
    return features(docs.select("doc_id", "text"), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        passes().alias("kept"), "rule")


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` whose text passes, with their own columns alone
    (whatever their names)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("pl_row"), "text")
    return features(packed, rules).select("pl_row", passes().alias("kept")).where("kept").select("pl_row.*")
