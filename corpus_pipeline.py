"""A training corpus from the documents of a folder: five stages, each written as Parquet and read again by the next.

Quality by nearest neighbours (rejected documents go), near-duplicates (the smallest id of a group stays), benchmark
decontamination (documents that hold a window of an item go), secrets (every reported span is replaced), packing into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.common import materialize
from quillstone.llm.decontamination import drop_contaminated
from quillstone.llm.near_dedup import keep_one
from quillstone.llm.packing import pack
from quillstone.llm.quality_knn import keep_good
from quillstone.llm.queries import tokenizer_path
from quillstone.llm.secret_scan import redact_secrets
from quillstone.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced; n_chars follows the text where there is such a column."""
    from pyspark.sql import functions as F

    out = redact_secrets(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: No SQL has a nearest-neighbour vote or a tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
