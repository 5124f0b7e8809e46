"""Registered queries: response parsing, negative cache, hits/misses,
progress, cost, triplets."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.text import WS_CLASS
from pairlane.operators import negatives as N
from pairlane.operators import triplets as TR
from pairlane.plans import sqltext as S
from pairlane.plans.common import pairs, with_pairs
from pairlane.plans.q_prompts import prompt_sql
from pairlane.plans.registry import query
from pairlane.sources import cache_io, fixtures
from pairlane.sources.fixtures import RESPONSES_SQL

NEG_TYPE, STRATEGY, MODEL = "component_swap", "chain_of_thought", "gpt-4o-mini"
N_PER = 5


# ----------------------------------------------------------------- spark ---

def parsed(spark, sf):
    return N.parse_responses(fixtures.responses(spark, sf))


def _ts(col):
    return F.concat(F.lit("2026-01-01T00:00:"), F.lpad((col % 60).cast("string"), 2, "0"), F.lit("Z"))


def cache_records(spark, sf):
    """Cache lines for every parsed answer: the response fixture keyed by
    the left part id is joined to that part's match row."""
    good, _ = parsed(spark, sf)
    prods = N.products(pairs(spark, sf), N_PER)
    g = good.withColumnRenamed("pair_id", "id_left")
    return prods.join(g.hint("merge"), "id_left").select(
        "cache_key", "pair_id", "product_text", "negative_text",
        F.col("item_idx").cast("int").alias("neg_idx"),
        F.lit(NEG_TYPE).alias("negative_type"), F.lit(STRATEGY).alias("strategy"),
        F.lit(MODEL).alias("model_id"), F.lit(N_PER).alias("n_negatives_requested"),
        F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.col("completion_tokens").cast("bigint").alias("completion_tokens"),
        _ts(F.regexp_extract("id_left", r"L(\d+)", 1).cast("bigint")).alias("timestamp"))


def shared_cache(spark, sf):
    """The answers of the run beside others with the same keys: a type, a strategy
    and a model that are not asked for, in part for products without an answer."""
    recs = cache_records(spark, sf)
    prods = N.products(pairs(spark, sf), N_PER)
    other = recs.limit(0).unionByName(prods.select(
        "cache_key", "pair_id", "product_text", F.lit("of another run").alias("negative_text"), F.lit(0).alias("neg_idx"),
        F.lit(NEG_TYPE).alias("negative_type"), F.lit(STRATEGY).alias("strategy"), F.lit(MODEL).alias("model_id"),
        F.lit(N_PER).alias("n_negatives_requested"), F.lit(0).cast("bigint").alias("prompt_tokens"),
        F.lit(0).cast("bigint").alias("completion_tokens"), F.lit("2026-01-01T00:00:00Z").alias("timestamp")))
    return (recs.unionByName(other.withColumn("negative_type", F.lit("phonetic")))
            .unionByName(other.withColumn("strategy", F.lit("zero_shot")))
            .unionByName(other.withColumn("model_id", F.lit("org/other"))))


# ------------------------------------------------------------------- sql ---

def _sq(x):
    return S.strip(x)


_UNFENCE = f"""
CASE WHEN starts_with({_sq('response')}, '```') THEN
  {_sq("array_to_string(list_filter(regexp_split_to_array(" + _sq('response') + ", '" + N.LINE_BREAKS + "'), lambda l: NOT starts_with(l, '```')), chr(10))")}
ELSE {_sq('response')} END"""

PARSE_SQL = RESPONSES_SQL.strip() + f""",
r1 AS (SELECT *, {_UNFENCE} AS t FROM responses),
r2 AS (SELECT *, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM r1),
r3 AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j -> '$.hard_negatives') = 'ARRAY'
                      THEN CAST(j -> '$.hard_negatives' AS JSON[]) END AS arr FROM r2),
items AS (SELECT pair_id, kind, prompt_tokens, completion_tokens,
          unnest(arr) AS item, unnest(generate_series(0, len(arr) - 1)) AS item_idx
          FROM r3 WHERE len(arr) > 0),
good AS (SELECT pair_id, kind, prompt_tokens, completion_tokens, item_idx,
         {_sq("(item ->> '$')")} AS negative_text
         FROM items WHERE json_type(item) = 'VARCHAR' AND {_sq("(item ->> '$')")} <> ''),
rejected AS (SELECT pair_id, kind FROM responses WHERE pair_id NOT IN (SELECT pair_id FROM good))"""

PROD_SQL = f"""prods AS (SELECT pair_id, id_left, {S.side_text('left')} AS product_text,
  sha256(lower({S.strip(S.side_text('left'))}) || '||n={N_PER}') AS cache_key FROM pairs WHERE label = 1)"""

CACHE_SQL = f"""cache AS (SELECT p.cache_key, p.pair_id, p.product_text, g.negative_text,
  CAST(g.item_idx AS INTEGER) AS neg_idx, '{NEG_TYPE}' AS negative_type, '{STRATEGY}' AS strategy,
  '{MODEL}' AS model_id, {N_PER} AS n_negatives_requested,
  CAST(g.prompt_tokens AS BIGINT) AS prompt_tokens, CAST(g.completion_tokens AS BIGINT) AS completion_tokens,
  '2026-01-01T00:00:' || lpad(CAST(CAST(substring(p.id_left, 2) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 'Z' AS timestamp
  FROM prods p JOIN good g ON g.pair_id = p.id_left)"""

ALL = [PARSE_SQL, PROD_SQL, CACHE_SQL]


@query("parse_responses", "WITH " + PARSE_SQL + "\nSELECT pair_id, item_idx, negative_text FROM good")
def _parse_responses(spark, sf):
    good, _ = parsed(spark, sf)
    return good.select("pair_id", "item_idx", "negative_text")


@query("parse_rejects", "WITH " + PARSE_SQL + "\nSELECT kind, count(*) AS n_rejected FROM rejected GROUP BY 1")
def _parse_rejects(spark, sf):
    _, bad = parsed(spark, sf)
    return bad.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rejected"))


@query("load_negative_cache", with_pairs(
    "SELECT cache_key, neg_idx, negative_text, timestamp FROM cache", *ALL))
def _load_negative_cache(spark, sf):
    path = cache_io.work_path(spark, "negcache")
    cache_io.append_negative_cache(shared_cache(spark, sf), path)
    # foreign lines in the same files: truncated JSON and key-less records
    resp = fixtures.responses(spark, sf)
    bad = resp.filter(F.col("kind").isin(3, 5)).select(
        F.lit(MODEL).alias("model_id"), F.lit(NEG_TYPE).alias("negative_type"),
        F.lit(STRATEGY).alias("strategy"),
        F.when(F.col("kind") == 5, F.col("response"))
        .otherwise(F.to_json(F.struct(F.col("pair_id"), F.lit("x").alias("negative_text")))).alias("value"))
    cache_io.append_raw_lines(bad, path)
    c = cache_io.load_negative_cache(spark, path, NEG_TYPE, STRATEGY, MODEL)
    return c.select("cache_key", "neg_idx", "negative_text", "timestamp")


_CACHE_COLS = ("cache_key, pair_id, product_text, negative_text, neg_idx, negative_type, strategy, model_id, "
               "n_negatives_requested, prompt_tokens, completion_tokens")


@query("append_negative_cache", with_pairs(
    f"SELECT {_CACHE_COLS}, timestamp FROM cache UNION ALL SELECT {_CACHE_COLS}, timestamp || '+1' FROM cache", *ALL))
def _append_negative_cache(spark, sf):
    """Append twice (a forced re-run) and read back: rows double, the
    newest-run view keeps one answer set per key."""
    path = cache_io.work_path(spark, "negcache")
    recs = cache_records(spark, sf)
    cache_io.append_negative_cache(recs, path)
    cache_io.append_negative_cache(recs.withColumn("timestamp", F.concat("timestamp", F.lit("+1"))), path)
    return cache_io.load_negative_cache(spark, path)


@query("append_failures", with_pairs(f"""
SELECT p.pair_id, p.product_text, '{NEG_TYPE}' AS negative_type, '{STRATEGY}' AS strategy, '{MODEL}' AS model_id,
  CASE WHEN r.j IS NULL THEN 'invalid json' WHEN json_type(r.j) <> 'OBJECT' THEN 'not an object'
       WHEN r.arr IS NULL OR len(r.arr) = 0 THEN 'hard_negatives empty or missing' ELSE 'all entries blank' END AS error,
  '2026-01-01T00:00:00Z' AS timestamp
FROM r3 r JOIN prods p ON p.id_left = r.pair_id WHERE r.pair_id NOT IN (SELECT pair_id FROM good)""", PARSE_SQL, PROD_SQL))
def _append_failures(spark, sf):
    _, bad = parsed(spark, sf)
    path = cache_io.work_path(spark, "failures")
    prods = N.products(pairs(spark, sf), N_PER).withColumnRenamed("pair_id", "match_pair_id")
    f = (bad.withColumnRenamed("pair_id", "id_left").join(prods.hint("merge"), "id_left")
         .select(F.col("match_pair_id").alias("pair_id"), "product_text",
                 F.lit(NEG_TYPE).alias("negative_type"), F.lit(STRATEGY).alias("strategy"),
                 F.lit(MODEL).alias("model_id"), "error",
                 F.lit("2026-01-01T00:00:00Z").alias("timestamp")))
    cache_io.append_failures(f, path)
    return spark.read.schema("pair_id string, product_text string, negative_type string, strategy string, "
                             "model_id string, error string, timestamp string").json(path)


@query("cache_hits", with_pairs("""
SELECT p.pair_id, p.product_text, c.negative_text, c.neg_idx, c.negative_type, c.strategy, c.model_id,
       CAST(NULL AS VARCHAR) AS timestamp
FROM prods p JOIN cache c ON c.cache_key = p.cache_key""", *ALL))
def _cache_hits(spark, sf):
    prods = N.products(pairs(spark, sf), N_PER)
    return N.cache_hits(prods, shared_cache(spark, sf), NEG_TYPE, STRATEGY, MODEL)


@query("cache_misses", with_pairs("""
SELECT cache_key, min(pair_id) AS pair_id, min(product_text) AS product_text, count(*) AS n_products
FROM prods WHERE cache_key NOT IN (SELECT cache_key FROM cache) GROUP BY 1""", *ALL))
def _cache_misses(spark, sf):
    prods = N.products(pairs(spark, sf), N_PER)
    return N.cache_misses(prods, shared_cache(spark, sf), NEG_TYPE, STRATEGY, MODEL)


_PROMPTS_SQL = (f"prompts AS (SELECT pair_id, {prompt_sql('product_text', repr(NEG_TYPE), repr(STRATEGY))} "
                "AS prompt FROM prods)")


@query("prompt_dry_run", with_pairs("""
SELECT m.pair_id, substring(m.product_text, 1, 80) AS product_preview, substring(pr.prompt, 1, 500) AS prompt_preview
FROM (SELECT cache_key, min(pair_id) AS pair_id, min(product_text) AS product_text FROM prods
      WHERE cache_key NOT IN (SELECT cache_key FROM cache) GROUP BY 1) m
JOIN prompts pr ON pr.pair_id = m.pair_id""", *ALL, _PROMPTS_SQL))
def _prompt_dry_run(spark, sf):
    from pairlane.operators import prompts as P
    prods = N.products(pairs(spark, sf), N_PER)
    miss = N.cache_misses(prods, shared_cache(spark, sf), NEG_TYPE, STRATEGY, MODEL)
    pr = P.build_prompts(miss.select("pair_id", "product_text"), NEG_TYPE, STRATEGY, N_PER, "parts")
    return pr.select("pair_id", F.substring("product_text", 1, 80).alias("product_preview"),
                     F.substring("prompt", 1, 500).alias("prompt_preview"))


@query("generation_progress", with_pairs("""
SELECT (SELECT count(*) FROM prods) AS n_products,
 (SELECT count(*) FROM prods WHERE cache_key IN (SELECT cache_key FROM cache)) AS n_cached_products,
 (SELECT count(*) FROM prods p JOIN cache c ON c.cache_key = p.cache_key) AS n_cached_negatives,
 (SELECT count(DISTINCT cache_key) FROM prods WHERE cache_key NOT IN (SELECT cache_key FROM cache)) AS n_to_generate,
 (SELECT count(*) FROM rejected) AS n_failed,
 (SELECT CAST(sum(prompt_tokens) AS BIGINT) FROM responses WHERE pair_id IN (SELECT pair_id FROM good)) AS prompt_tokens,
 (SELECT CAST(sum(completion_tokens) AS BIGINT) FROM responses WHERE pair_id IN (SELECT pair_id FROM good)) AS completion_tokens
""", *ALL))
def _generation_progress(spark, sf):
    prods = N.products(pairs(spark, sf), N_PER)
    cache = cache_records(spark, sf)
    good, bad = parsed(spark, sf)
    resp = fixtures.responses(spark, sf)
    keys = cache.select("cache_key").distinct()
    hit_prod = prods.join(keys, "cache_key", "left_semi")
    s = [prods.agg(F.count(F.lit(1)).alias("n_products")),
         hit_prod.agg(F.count(F.lit(1)).alias("n_cached_products")),
         prods.join(cache.select("cache_key"), "cache_key").agg(F.count(F.lit(1)).alias("n_cached_negatives")),
         prods.join(keys, "cache_key", "left_anti").agg(F.countDistinct("cache_key").alias("n_to_generate")),
         bad.agg(F.count(F.lit(1)).alias("n_failed")),
         resp.join(good.select("pair_id").distinct().hint("merge"), "pair_id", "left_semi").agg(
             F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
             F.sum("completion_tokens").cast("bigint").alias("completion_tokens"))]
    cols = []
    for d in s:  # each is a one-row aggregate: attach as scalar subqueries
        for c in d.columns:
            cols.append(d.select(c).scalar().alias(c))
    return spark.range(1).select(*cols)


_MODELS_SQL = """CASE kind % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o-2024-08-06'
 WHEN 2 THEN 'gpt-3.5-turbo-0125' ELSE 'llama-3-8b-instruct' END"""


def _model_col():
    k = F.col("kind") % 4
    return (F.when(k == 0, "gpt-4o-mini").when(k == 1, "gpt-4o-2024-08-06")
            .when(k == 2, "gpt-3.5-turbo-0125").otherwise("llama-3-8b-instruct"))


_PRICING_SQL = "pricing AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{k}', {a}, {b})" for i, (k, a, b) in enumerate(N.PRICING)) + \
    ") t(ord, model_key, price_in, price_out))"


@query("generation_cost", "WITH " + RESPONSES_SQL.strip() + ",\n" + _PRICING_SQL + f""",
u AS (SELECT {_MODELS_SQL} AS model_id, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens
      FROM responses GROUP BY 1),
m AS (SELECT u.*, arg_min(p.price_in, p.ord) AS pin, arg_min(p.price_out, p.ord) AS pout
      FROM u LEFT JOIN pricing p ON starts_with(u.model_id, p.model_key) GROUP BY ALL)
SELECT model_id, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(completion_tokens AS BIGINT) AS completion_tokens,
 round((prompt_tokens * coalesce(pin, 0.0) + completion_tokens * coalesce(pout, 0.0)) / 1000000, 6) AS cost_usd FROM m""")
def _generation_cost(spark, sf):
    usage = fixtures.responses(spark, sf).select(_model_col().alias("model_id"),
                                                 "prompt_tokens", "completion_tokens")
    return N.generation_cost(usage)


_NEGS_SQL = """negs AS (SELECT p.pair_id, c.negative_text FROM prods p JOIN cache c ON c.cache_key = p.cache_key)"""
_TRIP_SQL = f"""trip AS (
 SELECT m.pair_id, m.anchor_text, m.positive_text, n.negative_text
 FROM (SELECT pair_id, {S.side_text('left')} AS anchor_text, {S.side_text('right')} AS positive_text
       FROM pairs WHERE label = 1) m
 JOIN (SELECT pair_id, negative_text FROM (
        SELECT pair_id, negative_text, row_number() OVER (PARTITION BY pair_id
               ORDER BY md5('42|' || negative_text), negative_text) AS r FROM negs) WHERE r <= __RATIO__) n
 ON n.pair_id = m.pair_id)"""


def _negs(spark, sf):
    prods = N.products(pairs(spark, sf), N_PER)
    return N.cache_hits(prods, shared_cache(spark, sf), NEG_TYPE, STRATEGY, MODEL)


@query("triplets_from_negatives", with_pairs("SELECT * FROM trip", *ALL, _NEGS_SQL, _TRIP_SQL.replace("__RATIO__", "1")))
def _triplets_from_negatives(spark, sf):
    return TR.triplets_from_negatives(pairs(spark, sf), _negs(spark, sf), ratio=1, seed=42)


@query("sample_per_group", with_pairs("SELECT pair_id, negative_text FROM trip", *ALL, _NEGS_SQL,
                                      _TRIP_SQL.replace("__RATIO__", "4")))
def _sample_per_group(spark, sf):
    t = TR.triplets_from_negatives(pairs(spark, sf), _negs(spark, sf), ratio=4, seed=42)
    return t.select("pair_id", "negative_text")


@query("triplets_to_negatives", with_pairs("SELECT pair_id, negative_text FROM trip", *ALL, _NEGS_SQL,
                                           _TRIP_SQL.replace("__RATIO__", "1")))
def _triplets_to_negatives(spark, sf):
    return TR.triplets_to_negatives(
        TR.triplets_from_negatives(pairs(spark, sf), _negs(spark, sf), ratio=1, seed=42))


@query("triplet_ratio", with_pairs("""
SELECT (SELECT count(*) FROM trip) AS n_triplets, (SELECT count(*) FROM pairs WHERE label = 1) AS n_pairs,
 (SELECT count(*) FROM trip) // (SELECT count(*) FROM pairs WHERE label = 1) AS ratio""",
                                   *ALL, _NEGS_SQL, _TRIP_SQL.replace("__RATIO__", "4")))
def _triplet_ratio(spark, sf):
    t = TR.triplets_from_negatives(pairs(spark, sf), _negs(spark, sf), ratio=4, seed=42)
    nt = t.agg(F.count(F.lit(1)).alias("n_triplets"))
    npairs = pairs(spark, sf).filter("label = 1").agg(F.count(F.lit(1)).alias("n_pairs"))
    a, b = nt.scalar(), npairs.scalar()
    return spark.range(1).select(a.alias("n_triplets"), b.alias("n_pairs"),
                                 F.floor(a / b).cast("bigint").alias("ratio"))


@query("write_triplets", with_pairs(f"""
SELECT *, 'parts' AS category, 'train_100pct' AS split, '{NEG_TYPE}' AS negative_type, '{STRATEGY}' AS strategy,
       '{MODEL}' AS model_id FROM trip""", *ALL, _NEGS_SQL, _TRIP_SQL.replace("__RATIO__", "1")))
def _write_triplets(spark, sf):
    t = TR.triplets_from_negatives(pairs(spark, sf), _negs(spark, sf), ratio=1, seed=42)
    path = cache_io.work_path(spark, "triplets")
    cache_io.write_triplets(t, path, "parts", "train_100pct", NEG_TYPE, STRATEGY, MODEL)
    return spark.read.parquet(path)


def _pool_sql(seed=42):
    rt = S.side_text("right")
    return f"""
nm AS (SELECT pair_id, coalesce(is_hard_negative, false) AS hard, {rt} AS negative_text FROM pairs WHERE label = 0),
pool0 AS (SELECT * FROM nm WHERE hard = (SELECT count(*) > 0 FROM nm WHERE hard)),
pool AS (SELECT row_number() OVER (ORDER BY md5('{seed}|pool|' || pair_id), pair_id) - 1 AS pool_idx, negative_text FROM pool0),
ms AS (SELECT pair_id, {S.side_text('left')} AS anchor_text, {rt} AS positive_text,
       CAST(('0x' || substring(md5('{seed}|pick|' || pair_id), 1, 15)) AS BIGINT) % (SELECT count(*) FROM pool) AS pool_idx
       FROM pairs WHERE label = 1)"""


@query("contrastive_triplets", with_pairs("""
SELECT ms.pair_id, ms.anchor_text, ms.positive_text, pool.negative_text FROM ms JOIN pool USING (pool_idx)""",
                                          _pool_sql()))
def _contrastive_triplets(spark, sf):
    return TR.contrastive_triplets(pairs(spark, sf), 42)


@query("contrastive_triplets_anchor", with_pairs(f"""
SELECT m.pair_id, m.anchor_text, m.positive_text, b.negative_text
FROM (SELECT pair_id, id_left, {S.side_text('left')} AS anchor_text, {S.side_text('right')} AS positive_text
      FROM pairs WHERE label = 1) m
JOIN (SELECT id_left, arg_min(negative_text, k) AS negative_text FROM (
        SELECT id_left, {S.side_text('right')} AS negative_text,
               struct_pack(a := CASE WHEN is_hard_negative THEN 0 ELSE 1 END, b := md5('42|' || pair_id), c := {S.side_text('right')}) AS k
        FROM pairs WHERE label = 0) GROUP BY 1) b USING (id_left)"""))
def _contrastive_triplets_anchor(spark, sf):
    return TR.contrastive_triplets_anchor(pairs(spark, sf), 42)
