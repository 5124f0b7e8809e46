"""Registered queries: prompts for every match product."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.text import side_text
from pairlane.operators import prompts as P
from pairlane.plans import sqltext as S
from pairlane.plans.common import pairs, with_pairs
from pairlane.plans.registry import query

CATEGORY = "parts"
N_PER = 5
SAMPLE_SIZE = 5

PROD = f"prods AS (SELECT pair_id, {S.side_text('left')} AS product_text FROM pairs WHERE label = 1)"

# The expected text, written out by hand for five negatives in section "parts":
# a change of the sheets must be made here as well.
PROMPT_SQL = """(
'JOB: hard negatives for entity matching, catalogue section parts' || chr(10) || 'COUNT: 5' || chr(10)
|| 'TYPE: ' || <type> || chr(10) || 'CHANGE: ' || CASE <type>
 WHEN 'phonetic' THEN 'spelling of words, by ear; one or two letters a word'
 WHEN 'component_swap' THEN 'the value of a single attribute (a quantity, a size, a colour, a variant name)'
 WHEN 'abbreviation' THEN 'long words, into short forms'
 WHEN 'semantic_distractor' THEN 'the model, into a sibling the same maker sells'
 WHEN 'mixed' THEN 'one thing per text, a different type each time; append the type in parentheses' END
|| chr(10) || 'KEEP: ' || CASE <type>
 WHEN 'phonetic' THEN 'all digits and units'
 WHEN 'component_swap' THEN 'the rest of the text, letter for letter'
 WHEN 'abbreviation' THEN 'brand, model and attribute values'
 WHEN 'semantic_distractor' THEN 'brand and kind of article'
 WHEN 'mixed' THEN 'whatever that type keeps' END
|| chr(10) || 'STYLE: shop titles, each naming an article other than the source' || chr(10)
|| CASE WHEN <strategy> = 'zero_shot' THEN '' ELSE 'SAMPLE: ' || CASE <type>
 WHEN 'phonetic' THEN 'Brother HL-L2350DW Toner Black -> {"hard_negatives": ["Bruther HL-L2350DW Toner Black", "Brother HL-L2350DW Tonner Blak"]}'
 WHEN 'component_swap' THEN 'Bosch Drill 18V 2.0Ah Green -> {"hard_negatives": ["Bosch Drill 12V 2.0Ah Green", "Bosch Drill 18V 2.0Ah Blue"]}'
 WHEN 'abbreviation' THEN 'Stainless Steel Kettle 1.7 Litre -> {"hard_negatives": ["SS Kettle 1.7 L", "Stnls Stl Kettle 1.7 Ltr"]}'
 WHEN 'semantic_distractor' THEN 'Garmin Edge 530 Bike Computer -> {"hard_negatives": ["Garmin Edge 830 Bike Computer", "Garmin Edge 130 Plus Bike Computer"]}'
 WHEN 'mixed' THEN 'Philips Lamp 9W Warm White -> {"hard_negatives": ["Filips Lamp 9W Warm White (phonetic)", "Philips Lamp 13W Warm White (component_swap)"]}'
 END || chr(10) END
|| CASE WHEN <strategy> = 'chain_of_thought'
 THEN 'PLAN: in ''reasoning'', name the attributes of the source and the edit chosen for each text' || chr(10) ELSE '' END
|| 'SOURCE: ' || <product> || chr(10) || 'REPLY (bare JSON of this shape): '
|| CASE WHEN <strategy> = 'chain_of_thought' THEN '{"reasoning": "string", "hard_negatives": ["string"]}'
 ELSE '{"hard_negatives": ["string"]}' END)"""


def prompt_sql(product: str, neg_type: str, strategy: str) -> str:
    """``neg_type`` and ``strategy`` are SQL expressions."""
    return PROMPT_SQL.replace("<type>", neg_type).replace("<strategy>", strategy).replace("<product>", product)


def _prods(spark, sf):
    return pairs(spark, sf).filter("label = 1").select("pair_id", side_text("left").alias("product_text"))


def _one(strategy, neg_type="component_swap"):
    sql = with_pairs(
        f"SELECT pair_id, {prompt_sql('product_text', repr(neg_type), repr(strategy))} AS prompt FROM prods", PROD)

    def build(spark, sf):
        return P.build_prompts(_prods(spark, sf), neg_type, strategy, N_PER, CATEGORY).select("pair_id", "prompt")
    return sql, build


for _key, _strat in [("prompt_zero_shot", "zero_shot"), ("prompt_few_shot", "few_shot"),
                     ("prompt_cot", "chain_of_thought")]:
    _sql, _build = _one(_strat)
    query(_key, _sql)(_build)


_GRID_CELLS = " UNION ALL ".join(
    f"SELECT '{t}' AS negative_type, '{s}' AS strategy" for t in P.NEG_TYPES for s in P.STRATEGIES)


@query("prompt_grid", with_pairs(f"""
SELECT pair_id, negative_type, strategy, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5 FROM (
 SELECT p.pair_id, g.negative_type, g.strategy, {prompt_sql('p.product_text', 'g.negative_type', 'g.strategy')} AS prompt
 FROM prods p, ({_GRID_CELLS}) g)""", PROD))
def _prompt_grid(spark, sf):
    g = P.prompt_grid(_prods(spark, sf), N_PER, CATEGORY)
    return g.select("pair_id", "negative_type", "strategy", F.length("prompt").alias("prompt_chars"),
                    F.md5("prompt").alias("prompt_md5"))


@query("prompt_sample", with_pairs(f"""
SELECT s.pair_id, s.title_left, {prompt_sql('s.product_text', "'component_swap'", "'zero_shot'")} AS prompt
FROM (SELECT title_left, min(pair_id) AS pair_id, arg_min({S.side_text('left')}, pair_id) AS product_text
      FROM pairs WHERE label = 1 GROUP BY 1) s
ORDER BY md5('42|' || s.pair_id), s.pair_id LIMIT {SAMPLE_SIZE}"""))
def _prompt_sample(spark, sf, n: int = SAMPLE_SIZE):
    """``n`` products, one per distinct left title, in seeded hash order."""
    m = (pairs(spark, sf).filter("label = 1")
         .groupBy("title_left").agg(F.min_by(F.struct("pair_id", side_text("left").alias("product_text")),
                                             "pair_id").alias("s"))
         .select("title_left", "s.pair_id", "s.product_text"))
    top = m.orderBy(F.md5(F.concat(F.lit("42|"), "pair_id")), "pair_id").limit(n)
    return P.build_prompts(top, "component_swap", "zero_shot", N_PER, CATEGORY).select(
        "pair_id", "title_left", "prompt")
