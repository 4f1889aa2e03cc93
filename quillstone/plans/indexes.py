"""The stored lexical indexes of a folder's documents: built at the first question, opened by all later ones while the table is the same."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon, rbac
from ..sources import store
from ..sources.tables import spread, table
from . import search

# words of the documents' own language stand for the restricted topics
HR, RISK = ["idiot", "clown", "nicht auf"], ["ention", "heit"]


def tagged(spark: SparkSession, sf: str):
    """Documents with their security category and the roles that may see them."""
    d = spread(table(spark, sf, "documents"))
    return d.select("doc_id", "text", "source", rbac.security_category(F.col("text"), F.col("source"), HR, RISK).alias("category")).withColumn("allowed", rbac.allowed_roles(F.col("category")))


def documents_index(spark: SparkSession, sf: str, family: str) -> lexicon.Lexicon:
    """The index of all documents in a family of tokens, with the masks of their roles."""
    identity = {"documents": store.fingerprint(spark, f"{sf.rstrip('/')}/documents.parquet"), "family": family, "roles": rbac.ROLES, "words": [HR, RISK], "layout": 3}
    path = f"{store.shared_folder(spark)}/indexes/{identity['documents'][:24]}-{family}"
    found = lexicon.opened(spark, path, "doc_id", identity)
    if found is None:
        found = lexicon.build(tagged(spark, sf), "doc_id", search.family_tokens(family, "text"), path, identity, lexicon.role_mask(F.col("allowed")))
    return found


def index_of(spark: SparkSession, sf: str):
    return lambda family: documents_index(spark, sf, family)
