"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzline.llm import blob_ledger, byte_bpe, chunk_bpe, language_id, line_cleaning, merkle, minhash_dedup, oracles, raking, repeated_spans, spot_signatures, surrogates, toxic_grammar, whitening


#: Languages at set shares, sources evened out by half, topics alike.
TARGET_MIX = raking.Mix(exponents={"source": 0.5, "lang": 1.0, "topic": 0.0}, shares={"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}})


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the BPE queries; QUARTZLINE_TOKENIZER names another."""
    if path := os.environ.get("QUARTZLINE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(_documents(spark, sf_dir))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_components(_documents(spark, sf_dir), minhash_dedup.Settings(words=4))


def op3_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix_documents(_documents(spark, sf_dir), TARGET_MIX).drop("text", "n_chars")


def surrogate_key() -> str:
    """The secret behind the surrogates, from QUARTZLINE_SURROGATE_KEY; without it one for trials, which is public."""
    return os.environ.get("QUARTZLINE_SURROGATE_KEY") or "trial"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(_documents(spark, sf_dir), surrogate_key(), count="n_entities").select("doc_id", "n_entities", "text")


def op5_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_documents(_documents(spark, sf_dir), tokenizer_path())


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blob_ledger.secret_report(_documents(spark, sf_dir))


def op7_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_grammar.toxicity_report(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.successors_report(_documents(spark, sf_dir))


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(_documents(spark, sf_dir))


def op10_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cleaning.line_report(_documents(spark, sf_dir))


def op11_fst_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's exact deviation as bigint; null where it is beyond one."""
    found = whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_minhash_dedup, op3_raking, op4_surrogates, op5_chunk_bpe, op6_blob_ledger, op7_toxic_grammar, op8_spot_signatures, op9_repeated_spans, op10_line_cleaning, op11_fst_bpe, op12_qdwh_whitening, op13_merkle_manifest)
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB SQL, where SQL can express them."""
    return dict(oracles.SQL)
