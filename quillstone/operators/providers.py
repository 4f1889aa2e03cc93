"""Models behind small interfaces, with deterministic stand-ins for tests. No model or network is part of this library."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import store
from . import scan


def embed(c: Column, provider: Callable[[list[str]], list[list[float]]], batch: int = 100) -> Column:
    """Vectors of texts by a provider, in batches; a wrong count is an error."""

    def run(texts: pd.Series) -> pd.Series:
        out = []
        values = ["" if t is None else t for t in texts]
        for at in range(0, len(values), batch):
            got = provider(values[at : at + batch])
            if len(got) != len(values[at : at + batch]):
                raise ValueError("the provider returned another number of vectors")
            out += [[float(x) for x in v] for v in got]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(c)


def pair_scores(question: Column, text: Column, scorer: Callable[[list[tuple[str, str]]], list[float]]) -> Column:
    """One score per (question, text) pair by a scorer."""

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        got = scorer(list(zip(q.fillna(""), t.fillna(""), strict=True)))
        if len(got) != len(q):
            raise ValueError("the scorer returned another number of scores")
        return pd.Series(got, dtype="float64")

    return F.pandas_udf(run, "double")(question, text)


def refine(rows: DataFrame, key: str, order: list[Column], needed: Column, answer: Callable[[dict], dict | None], schema: str, budget: int, attempts: int | None = None) -> DataFrame:
    """Rows that need a model's answer, in order, while the budget of successes lasts; rows without one keep nulls in the new columns.

    A failure (null or an exception) is free. Rows are asked in waves, each answered in tasks: a wave is as long as the successes
    that are left, so that no answer is wasted; after a wave without any, the next is twice as long. The rows answered are those of
    asking one after another. attempts bounds the rows asked. The key must tell the rows apart; schema names it first.
    """
    from pyspark.sql.types import StructType

    fields = [f.name for f in StructType.fromDDL(schema).fields]
    waiting = scan.numbers(rows.filter(needed), [], [*order, F.col(key)], "__at")
    waiting = store.spill(waiting, "waiting")
    total = min(waiting.count(), attempts if attempts is not None else 2**62)

    def ask(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                at = row.pop("__at")
                try:
                    got = answer(row)
                except Exception:  # noqa: BLE001 - a failed call is a free attempt
                    got = None
                if got is not None:
                    out.append({**{f: got.get(f) for f in fields}, key: row[key], "__at": at})
            yield pd.DataFrame(out, columns=[*fields, "__at"])

    given, at, left, wave = None, 0, budget, budget
    while left > 0 and at < total:
        upto = min(at + wave, total)
        part = waiting.filter((F.col("__at") > at) & (F.col("__at") <= upto))
        got = store.spill(part.mapInPandas(ask, f"{schema}, `__at` long"), "answers")
        n = got.count()
        if n > left:  # a longer wave: the first ones in order count
            got = store.spill(got.orderBy("__at").limit(left), "answers")
            n = left
        given = got if given is None else given.unionByName(got)
        at, left = upto, left - n
        wave = left if n else wave * 2
    if given is None:
        given = rows.sparkSession.createDataFrame([], f"{schema}, `__at` long")
    return rows.join(F.broadcast(given.drop("__at")), key, "left")  # at most `budget` rows


def hash_embedding(dimension: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in: unit vectors from digests of words."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split():
                d = hashlib.sha256(w.encode()).digest()
                v[d[0] % dimension] += 1 if d[1] & 1 else -1
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return run


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """A stand-in: share of the question's words in the text."""
    return [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) for q, t in pairs]


def query_set(questions: DataFrame, question: str, text: str, variants: DataFrame | None = None, most: int = 3) -> DataFrame:
    """question, query_id, text, origin: Q0 the original, Q1… the accepted variants (question, text, order)."""
    base = questions.select(question, F.lit("Q0").alias("query_id"), F.col(text).alias("text"), F.lit("original").alias("origin"))
    if variants is None:
        return base
    n = F.row_number().over(W.partitionBy(question).orderBy("order"))
    more = variants.withColumn("__n", n).filter(F.col("__n") <= most).select(question, F.concat(F.lit("Q"), F.col("__n").cast("string")).alias("query_id"), F.col("text"), F.lit("variant").alias("origin"))
    return base.unionByName(more)


def prompt_key(text: Column, settings: dict) -> Column:
    """A prompt's name: SHA-256 of its text and of the settings it is asked with."""
    return F.sha2(F.concat(F.lit(json.dumps(settings, sort_keys=True, ensure_ascii=False)), F.lit("\n"), F.coalesce(text, F.lit(""))), 256)


def generated(spark: SparkSession, path: str, questions: DataFrame, question: str, text: str, settings: dict, generate: Callable[[str], list[str]]) -> DataFrame:
    """question, key, variants, status of every question: cached, generated, or failed (asked again next time).

    A store of answers keyed by prompt: only prompts that it lacks are asked, each once, in tasks; a failed one is not stored.
    """
    asked = questions.select(question, F.col(text).alias("__text"), prompt_key(F.col(text), settings).alias("key"))
    known = store.load(spark, path, "answers") if store.manifest(spark, path) else spark.createDataFrame([], "key string, variants array<string>")

    def ask(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["__text"], strict=True):
                try:
                    out.append((k, [str(v) for v in generate(t)]))
                except Exception:  # noqa: BLE001 - reported by its status
                    continue
            yield pd.DataFrame(out, columns=["key", "variants"])

    new = asked.join(known, "key", "left_anti").groupBy("key").agg(F.min("__text").alias("__text"))
    new = store.spill(new.mapInPandas(ask, "key string, variants array<string>"), "generated")
    status = F.when(F.col("old").isNotNull(), "cached").when(F.col("fresh").isNotNull(), "generated").otherwise("failed")
    rows = asked.join(known.withColumnRenamed("variants", "old"), "key", "left").join(new.withColumnRenamed("variants", "fresh"), "key", "left")
    out = store.spill(rows.select(question, "key", F.coalesce("old", "fresh").alias("variants"), status.alias("status")), "variants")  # before the store moves on
    if store.manifest(spark, path) is None:
        store.save({"answers": (new, "key", None, ())}, path)
    else:
        store.upsert(spark, path, "answers", new)
    return out


def accepted_variants(found: DataFrame, questions: DataFrame, question: str, text: str) -> DataFrame:
    """question, text, order of variants that are not blank, not the question itself and not a repeat, by their normalised text."""
    from ..functions.text import normalize_for_dedupe

    each = found.select(question, F.posexplode("variants").alias("order", "text")).join(questions.select(question, normalize_for_dedupe(F.col(text)).alias("__own")), question)
    each = each.withColumn("__n", normalize_for_dedupe(F.col("text"))).filter((F.col("__n") != "") & ~F.col("__n").eqNullSafe(F.col("__own")))
    first = each.withColumn("__r", F.row_number().over(W.partitionBy(question, "__n").orderBy("order"))).filter("__r = 1")
    return first.select(question, "text", "order")


def search_status(queries: DataFrame, failed: DataFrame, question: str) -> DataFrame:
    """question, n_queries, n_failed, status: single_query, multi_query or multi_query_partial; a failed original query is an error when rows are read.

    queries: question, query_id; failed: question, query_id of searches that did not run through.
    """
    rows = queries.select(question, "query_id").join(failed.select(question, "query_id", F.lit(True).alias("__bad")).distinct(), [question, "query_id"], "left")
    counted = rows.groupBy(question).agg(F.count("*").alias("n_queries"), F.count_if("__bad").alias("n_failed"), F.coalesce(F.bool_or(F.col("__bad") & (F.col("query_id") == "Q0")), F.lit(False)).alias("__q0"))
    stop = F.raise_error(F.concat(F.lit("the original query failed: "), F.col(question).cast("string")))
    status = F.when(F.col("__q0"), stop).when(F.col("n_failed") > 0, "multi_query_partial").when(F.col("n_queries") > 1, "multi_query").otherwise("single_query")
    return counted.select(question, "n_queries", "n_failed", status.cast("string").alias("status"))


class OcrProvider(Protocol):
    """Recognises the text of a page image."""

    def read(self, image: bytes) -> str: ...


def recognise(pages: DataFrame, image: str, make: Callable[[], OcrProvider], out: str = "text") -> DataFrame:
    """Pages with their recognised text; the provider is made once in each task, a page that fails gives null."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def read(rows):
        tool = make()
        for pdf in rows:
            said = []
            for data in pdf[image]:
                try:
                    said.append(tool.read(bytes(data)) if data is not None else None)
                except Exception:  # noqa: BLE001 - a page that cannot be read is reported by its null
                    said.append(None)
            yield pdf.assign(**{out: said})

    return pages.mapInPandas(read, f"{columns}, `{out}` string")
