"""File scans: JSON chunks, CSV of unknown encoding, HTML with its meta tags, PDF pages, audit lines, gold questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import document_id
from ..operators.html import meta_content
from ..operators.validation import codes, page_faults
from ..streaming.audit import LINE

CHUNK_SCHEMA = "chunk_id string, strategy string, source string, page_start int, page_end int, structure_path string, structure_detected boolean, text string"
# Encodings in the order in which they are tried.
ENCODINGS = ["utf-8-sig", "utf-8", "cp1258", "latin-1"]
SCOPES = ["in_scope", "out_of_scope"]


def json_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON files that hold an array, or an object with an array of chunks; with their file."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    array = F.from_json("value", f"array<struct<{CHUNK_SCHEMA.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>")
    wrapped = F.from_json("value", f"struct<chunks:array<struct<{CHUNK_SCHEMA.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>>")
    rows = raw.select("file", F.when(F.ltrim("value").startswith("["), array).otherwise(wrapped["chunks"]).alias("c"))
    checked = rows.select("file", F.when(F.col("c").isNull(), F.raise_error(F.concat(F.lit("neither an array nor chunks: "), "file"))).otherwise(F.col("c")).alias("c"))
    return checked.select("file", F.inline("c"))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header and quoted line ends; all columns text; a byte order mark goes."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding, text: the first encoding that decodes a file."""

    def decode(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                for enc in ENCODINGS:
                    try:
                        out.append((name, enc, bytes(data).decode(enc)))
                        break
                    except UnicodeDecodeError:
                        continue
            yield pd.DataFrame(out, columns=["file", "encoding", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "file string, encoding string, text string")


def csv_any_encoding(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of CSV files of any of the encodings, with their file."""
    import csv
    import io

    def parse(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = [(f, *(r.get(c) for c in columns)) for f, t in zip(pdf["file"], pdf["text"], strict=True) for r in csv.DictReader(io.StringIO(t))]
            yield pd.DataFrame(out, columns=["file", *columns])

    return decoded_files(spark, path).mapInPandas(parse, "file string, " + ", ".join(f"`{c}` string" for c in columns))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, title, html: the id from a meta tag, else from the file's stem."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return raw.select("file", document_id(meta_content(F.col("value"), "doc_id"), stem).alias("doc_id"), meta_content(F.col("value"), "title").alias("title"), F.col("value").alias("html"))


def pdf_pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """file, page, text, error of each page; reader gives a file's page texts (default: PyMuPDF, if installed)."""

    def pages(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def default(data: bytes) -> list[str]:
            import fitz

            return [p.get_text() for p in fitz.open(stream=data, filetype="pdf")]

        for pdf in rows:
            out = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(name, i + 1, t, None) for i, t in enumerate((reader or default)(bytes(data)))]
                except Exception as e:  # one file's fault stays its own
                    out.append((name, 0, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file", "page", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "file string, page int, text string, error string")


def with_ocr(pages: DataFrame, ocr: DataFrame | None) -> DataFrame:
    """Pages whose file has any faulty page take the text of OCR (file, page, text) where it succeeded; otherwise their own."""
    checked = pages.withColumn("faults", page_faults(F.col("text"))).withColumn("__bad", F.max((F.size("faults") > 0).cast("int")).over(W.partitionBy("file")) == 1)
    if ocr is None:
        return checked.withColumn("ocr_used", F.lit(False)).withColumnRenamed("__bad", "needs_ocr")
    better = ocr.select("file", "page", F.col("text").alias("__ocr"))
    done = checked.join(better, ["file", "page"], "left")
    use = F.col("__bad") & F.col("__ocr").isNotNull()
    return done.withColumn("text", F.when(use, F.col("__ocr")).otherwise(F.col("text"))).withColumn("ocr_used", use).withColumnRenamed("__bad", "needs_ocr").drop("__ocr")


def audit_lines(spark: SparkSession, path: str, last: int | None = None, schema: str | None = None) -> DataFrame:
    """Audit events of JSON lines, newest first; only the last ones if asked."""
    schema = schema or LINE
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).orderBy(F.col("timestamp_utc").desc(), "request_id")
    return rows.limit(last) if last else rows


def question_faults(key: str, question: str, scope: str, relevant: str):
    """Codes for a gold question: missing fields, unknown scope, labels that contradict the scope."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return codes(
        (blank(key), "id"), (blank(question), "question"), (F.coalesce(~F.col(scope).isin(SCOPES), F.lit(True)), "scope"),
        ((F.col(scope) == "in_scope") & (F.coalesce(F.size(relevant), F.lit(0)) <= 0), "no_relevant"), ((F.col(scope) == "out_of_scope") & (F.size(relevant) > 0), "unexpected_relevant"),
    )


def missing_gold(relevant: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Gold ids that the store lacks; must be empty."""
    return relevant.join(store.select(key), key, "left_anti")
