"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlane.llm.common import table

TOKENIZERS = "/opt/tokenizers"
SEQUENCE = 2048


def op1_quality_rules(spark: SparkSession, sf_dir: str, rules=None) -> DataFrame:
    from pairlane.llm import quality
    return quality.judge(table(spark, sf_dir, "documents"), rules or quality.RULES)


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlane.llm.perspectives import rotate
    return rotate(table(spark, sf_dir, "conversations"))


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    from pairlane.llm.token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), f"{tokenizers}/piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    from pairlane.llm.lattice import encode_documents
    return encode_documents(table(spark, sf_dir, "documents"), f"{tokenizers}/piece_bpe_32k.model")


def op5_packing(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    from pairlane.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), f"{tokenizers}/word_bpe_49k.json", 1, SEQUENCE)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlane.llm.topk import integer_vectors, top_k
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op7_token_file(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    from pairlane.llm.dac import token_file
    return token_file(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", 2)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlane.llm import credentials
    return credentials.report(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlane.llm.ngram_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlane.llm.toxicity import toxicity
    return toxicity(spark, table(spark, sf_dir, "documents"), sf_dir)


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlane.llm.flat_graph import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlane.llm.divergence import audit
    return audit(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairlane.llm.runs import report
    return report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_perspectives, op3_token_counts, op4_sentencepiece,
                                   op5_packing, op6_topk, op7_token_file, op8_secrets,
                                   op9_ngram_join, op10_toxicity, op11_near_vectors,
                                   op12_divergence, op13_runs)}

from pairlane.llm.divergence import AUDIT_SQL  # noqa: E402
from pairlane.llm.perspectives import ROTATE_SQL  # noqa: E402

SQL: dict[str, str] = {"op2_perspectives": ROTATE_SQL, "op12_divergence": AUDIT_SQL}
