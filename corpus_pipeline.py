"""The corpus pipeline: toxicity, quality rules, near duplicates, secret scans
and packing, each stage over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  Empty tables give empty results; a null text
counts as an empty one; extra columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm import credentials, ngram_join, packing, quality, toxicity
from pairlane.llm.common import stored, table

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END_ID, SEQUENCE = 1, 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more (all labelled rows may train)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("pl_row"),
                         F.col("doc_id"), F.col("text"))
    model = toxicity.fit(packed, table(spark, sf_dir, "labels"))
    return toxicity.score(packed, model, "pl_score").where("pl_score < 0.5").select("pl_row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the quality rules."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates (five-word
    shingles, Jaccard 0.8)."""
    return ngram_join.keep_first(docs, 5, 80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces found credentials in the texts."""
    return credentials.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences."""
    return packing.pack_documents(docs, TOKENIZER, END_ID, SEQUENCE)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("ngram_jaccard_join", drop_near_copies),
          ("secret_scans", redact_secrets), ("packing", pack)]

#: A trained model and a tokenizer are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
