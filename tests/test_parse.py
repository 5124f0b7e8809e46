"""Answer parsing hand cases."""

from pairlane.operators.negatives import parse_responses


def _parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "pair_id int, response string")
    good, bad = parse_responses(df)
    g = {}
    for r in good.orderBy("pair_id", "item_idx").collect():
        g.setdefault(r["pair_id"], []).append(r["negative_text"])
    return g, {r["pair_id"]: r["error"] for r in bad.collect()}


def test_cases(spark):
    texts = [
        '{"hard_negatives": ["a", " b "]}',
        '```json\n{"hard_negatives": ["c"]}\n```',
        '```\r\n{"hard_negatives": ["d"]}\r\n```',
        '{"reasoning": "r", "hard_negatives": ["e", 7, "", null, ["x"]]}',
        '{"hard_negatives": []}',
        '{"hard_negatives": ["  ", ""]}',
        '{"hard_negatives": ["trunc',
        '[1, 2]',
        '{"other": 1}',
        '{"hard_negatives": "not a list"}',
    ]
    g, bad = _parse(spark, texts)
    assert g == {0: ["a", "b"], 1: ["c"], 2: ["d"], 3: ["e"]}
    assert set(bad) == {4, 5, 6, 7, 8, 9}
    assert bad[6] == "invalid json" and bad[7] == "not an object"
