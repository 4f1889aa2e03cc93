"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import oracles


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf, "documents"))


def op2_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf, "documents"), with_text=False)


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(table(spark, sf, "documents"))


def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_quality_knn(spark: SparkSession, sf: str) -> DataFrame:
    from .quality_knn import classify_quality

    return classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_media_shards(spark: SparkSession, sf: str) -> DataFrame:
    from .media_shards import media_columns

    return media_columns(table(spark, sf, "documents"))


def op10_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    from .html_main_text import html_main_text

    return html_main_text(table(spark, sf, "pages"))


def op11_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf, "documents"))


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    from .lexical_search import search

    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf, "documents"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "pipeline": pipeline,
    "op1_license_scan": op1_license_scan,
    "op2_near_dedup": op2_near_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_packing": op4_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_quality_knn": op8_quality_knn,
    "op9_media_shards": op9_media_shards,
    "op10_html_main_text": op10_html_main_text,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The other operators have no SQL (tokenizers, sketches with verified components, media, a fitted classifier, HTML); tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_license_scan": oracles.licenses(),
    "op3_substring_dedup": oracles.substrings(),
    "op5_secret_scan": oracles.secrets(),
    "op7_decontamination": oracles.contamination(),
    "op11_jaccard_join": oracles.jaccard(),
    "op12_lexical_search": oracles.lexical(),
}
