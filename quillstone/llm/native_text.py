"""Words and row keys as DataFrame expressions, for the operators that stay in the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that separate words: all but 0-9, A-Z and a-z.
_GAPS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def words_of(c: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased; null has none."""
    spaced = F.translate(F.coalesce(c, F.lit("")), _UPPER + _GAPS, _UPPER.lower() + " " * len(_GAPS))
    return F.array_remove(F.split(spaced, " "), "")


def text_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart whose id is repeated or null; rows that agree in id and text share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def small_rows(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A table of parameter rows from one literal, without Python data on the executors."""
    names = [name for name, _ in schema]
    kind = "array<struct<" + ", ".join(f"`{name}`: {kind}" for name, kind in schema) + ">>"
    listed = json.dumps([dict(zip(names, row, strict=True)) for row in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(listed), kind)))


#: A table is broadcast only up to so many rows and bytes (as text); beyond, Spark shuffles both sides (AQE splits hot keys).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def bounded(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a table whose rows and bytes were counted; otherwise leave the join to Spark. The table should be written or small."""
    held = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if held["n"] <= most and held["size"] <= most_bytes else df
