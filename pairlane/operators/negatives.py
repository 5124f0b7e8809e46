"""Hard-negative data path: response parsing, cache keys, cache hits and
misses, generation progress and cost.

The cache is an append-only JSON-lines table; lookups are joins on the
content key (never a driver-side dict), misses an anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlane.functions.text import negative_cache_key, py_strip, side_text

# Line breaks recognised by Python's str.splitlines().
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
FENCE = "```"

# Negative types and prompt strategies.
NEG_TYPES = ["phonetic", "component_swap", "abbreviation", "semantic_distractor", "mixed"]
STRATEGIES = ["zero_shot", "few_shot", "chain_of_thought"]

# USD per 1M tokens (input, output); the first id that
# prefixes the model id wins, in this order; unknown models cost 0.
PRICING = [
    ("gpt-3.5-turbo", 0.50, 1.50),
    ("gpt-3.5-turbo-0125", 0.50, 1.50),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4o", 5.00, 15.00),
]


def unfence(col: "F.Column") -> "F.Column":
    """Strip; if the text starts with a code fence drop every line that
    starts with one, re-join and strip again."""
    t = py_strip(col)
    lines = F.split(t, LINE_BREAKS)
    kept = F.array_join(F.filter(lines, lambda l: ~l.startswith(FENCE)), "\n")
    return F.when(t.startswith(FENCE), py_strip(kept)).otherwise(t)


def parse_responses(responses: DataFrame, text_col: str = "response",
                    keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """-> (good, rejected).

    good: one row per kept negative (item_idx = position in the answer
    list, negative_text stripped).  Only JSON *string* items that are not
    blank are kept.  rejected: answers that are not JSON, not an object, lack
    a non-empty ``hard_negatives`` list, or keep no item; with a reason."""
    keep = keep or [c for c in responses.columns if c != text_col]
    v = parsed_items(responses, text_col, keep)
    return explode_items(v, keep), v.filter(F.size("_items") == 0).select(*keep, "error")


def parsed_items(responses: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """One row per answer: the kept items (position, text) and, where there are
    none, the reason.  Stateless, so a stream may use it."""
    v = responses.select(*keep, F.try_parse_json(unfence(F.col(text_col))).alias("_v"))
    arr = F.try_variant_get(F.col("_v"), "$.hard_negatives", "array<variant>")
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    v = v.select(*keep, "_v", is_object.alias("_object"), F.when(is_object, arr).alias("_arr"))
    texts = F.transform("_arr", lambda x, i: F.struct(
        i.alias("item_idx"), F.when(F.schema_of_variant(x) == "STRING", py_strip(F.try_variant_get(x, "$", "string")))
        .alias("negative_text")))
    items = F.coalesce(F.filter(texts, lambda x: x["negative_text"] != ""),
                       F.array().cast("array<struct<item_idx:int,negative_text:string>>"))
    reason = (F.when(F.col("_v").isNull(), "invalid json")
              .when(~F.col("_object"), "not an object")
              .when(F.col("_arr").isNull() | (F.size("_arr") == 0), "hard_negatives empty or missing")
              .otherwise("all entries blank"))
    return v.select(*keep, items.alias("_items"), reason.alias("error"))


def explode_items(parsed: DataFrame, keep: list[str]) -> DataFrame:
    return parsed.select(*keep, F.inline("_items"))


def products(pairs: DataFrame, n_per_product: int = 5) -> DataFrame:
    """Left side of every match row with its cache key."""
    m = pairs.filter(F.col("label") == 1).select("pair_id", "id_left",
                                                  side_text("left").alias("product_text"))
    return m.withColumn("cache_key", negative_cache_key("product_text", n_per_product))


def of_run(cache: DataFrame, neg_type: str, strategy: str, model_id: str) -> DataFrame:
    """The answers of one run: an answer of another type, strategy or model is
    none, though its key (text and number of answers) is the same."""
    return cache.filter((F.col("negative_type") == neg_type) & (F.col("strategy") == strategy)
                        & (F.col("model_id") == model_id))


def cache_hits(prods: DataFrame, cache: DataFrame, neg_type: str, strategy: str,
               model_id: str) -> DataFrame:
    """Products with a cached answer of the run, one row per cached negative; the
    timestamp is NULL on hits."""
    c = of_run(cache, neg_type, strategy, model_id)
    return prods.join(c.select("cache_key", "neg_idx", "negative_text", "negative_type", "strategy", "model_id"),
                      "cache_key").select(
        "pair_id", "product_text", "negative_text", "neg_idx", "negative_type", "strategy", "model_id",
        F.lit(None).cast("string").alias("timestamp"))


def cache_misses(prods: DataFrame, cache: DataFrame, neg_type: str, strategy: str, model_id: str) -> DataFrame:
    """Products still to generate in the run; identical products (same key)
    generate once (the first pair by id asks)."""
    done = of_run(cache, neg_type, strategy, model_id).select("cache_key").distinct()
    return prods.join(done, "cache_key", "left_anti").groupBy("cache_key").agg(
        F.min("pair_id").alias("pair_id"), F.min("product_text").alias("product_text"),
        F.count(F.lit(1)).alias("n_products"))


def price_columns(model_id: "F.Column") -> tuple["F.Column", "F.Column"]:
    """(price_in, price_out) of the first pricing key that prefixes the model
    id, in list order; 0 for unknown models.  The list is a handful of fixed
    literals, so this is a CASE chain, not a join."""
    pin = pout = None
    for key, a, b in PRICING:
        cond = model_id.startswith(key)
        pin = F.when(cond, F.lit(a)) if pin is None else pin.when(cond, F.lit(a))
        pout = F.when(cond, F.lit(b)) if pout is None else pout.when(cond, F.lit(b))
    return pin.otherwise(F.lit(0.0)), pout.otherwise(F.lit(0.0))


def generation_cost(usage: DataFrame) -> DataFrame:
    """usage(model_id, prompt_tokens, completion_tokens) summed per model
    and priced per 1M tokens."""
    u = usage.groupBy("model_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"),
                                      F.sum("completion_tokens").alias("completion_tokens"))
    pin, pout = price_columns(F.col("model_id"))
    cost = (F.col("prompt_tokens") * pin + F.col("completion_tokens") * pout) / 1_000_000
    return u.select("model_id", F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
                    F.col("completion_tokens").cast("bigint").alias("completion_tokens"),
                    F.round(cost, 6).alias("cost_usd"))
