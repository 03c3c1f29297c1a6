"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import alignment, bpe, decontaminate, language, media, resampling, sharding, simhash, suffix_dedup, tokens, toxicity
from attesta.llm import url_filter, vectors

Query = Callable[[SparkSession, str], DataFrame]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_token_counts": tokens.query,
        "op2_decontamination": decontaminate.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_simhash": simhash.query,
        "op5_url_filter": url_filter.query,
        "op6_language_id": language.query,
        "op7_hilbert_sharding": sharding.query,
        "op8_bpe_lexicon": bpe.query,
        "op9_media_sequences": media.query,
        "op10_toxicity": toxicity.query,
        "op11_alignment": alignment.query,
        "op12_embedding_dedup": vectors.query,
        "op13_resampling": resampling.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter.ORACLE, "op12_embedding_dedup": vectors.ORACLE, "op13_resampling": resampling.ORACLE}
