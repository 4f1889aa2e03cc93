"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Each text is searched once for every kind of candidate. Places come from splitting the text at the matches: a match starts
after the pieces and matches before it. The hash of each candidate's value is aggregated over the corpus by distinct owners
and distinct repositories within an owner: a value that many owners hold is a copied example, one held by few owners and
rich in characters looks live. Base kinds are always reported; the added kinds only when they look live or have an
unmistakable form.

Null and empty texts have no spans; very long ones are one row of one task. Repeated rows give one result each; null ids, owners
and repositories count as values; spans that start at one place come in the order of kinds. An empty table gives an empty result.
Extra columns are not read, whatever their names; redaction returns them as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize
from .native_text import text_key

# Candidate patterns. name, pattern, group of the value, least length of the value, strings of which a text has one.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A private key from its BEGIN line to the next END line, with no other dashed line between; where that is missing, to the end of the
#: base64 lines that follow (also with line ends written as \\n). Java and RE2 read it alike: the SQL has the same pattern.
PEM = (
    r"(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:[\s\\rn]*(?:Proc-Type|DEK-Info|Content-Domain|Version|Comment):[^\r\n\\]*){0,8}(?:\s*[A-Za-z0-9+/=\\]{40,})*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/=]+\r?(?m:$))?))"
)
KINDS = [
    ("assign", ASSIGN, 2, 12, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18, ("akia",)),
    ("hex", r"([0-9a-f]{16,})", 1, 16, ()),  # runs of 16 and more are found whole, as by [0-9a-f]+ with a length test
    ("pem", PEM, 1, 0, ("-----begin",)),
    ("github", r"(gh[pousr]_[A-Za-z0-9]{20,})", 1, 0, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 0, ("xox",)),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 0, ("eyj",)),
    ("urlauth", r"([a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@)", 1, 0, ("://",)),
]
BASE_KINDS = 3
#: A value of more owners, or of more repositories for each owner, is a copied example; a live-looking value has at least so many distinct characters.
MAX_OWNERS, MAX_REPOS, MIN_DISTINCT = 2, 1000, 6


def _found(text: Column, low: Column, kind: int) -> Column:
    """Matches of one kind in order: kind, number, length of the piece before, length, hash and richness of the value, kept."""
    _, pattern, group, least, hints = KINDS[kind]
    none = F.array().cast("array<string>")
    hinted = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in hints]) if hints else F.lit(True)
    matches = F.when(hinted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    pieces = F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(none)
    value = lambda m: F.regexp_extract(m, pattern, group) if group > 1 else m
    return F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p")),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(z["p"]).alias("before"), F.length(z["m"]).alias("size"), F.sha2(value(z["m"]), 256).alias("value"),
            F.size(F.array_distinct(F.split(value(z["m"]), ""))).alias("rich"), (F.length(value(z["m"])) >= least).alias("kept"),
        ),
    )


def candidate_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> tuple[DataFrame, DataFrame]:
    """(texts without candidates, texts with theirs), written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("key"), name(owner_col).alias("owner"), name(repo_col).alias("repo"), text.alias("text"), F.lower(text).alias("low"))
    found = rows.select("id", "key", "owner", "repo", F.concat(*(_found(F.col("text"), F.col("low"), k) for k in range(len(KINDS)))).alias("found"))
    scan = materialize(found, "secret-scan")
    return scan.filter(F.size("found") == 0), scan.filter(F.size("found") > 0)


def ownership(candidates: DataFrame) -> DataFrame:
    """Owners and repositories of each value: distinct (value, owner, repository) first, so a hot value is summed in parts."""
    held = candidates.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = held.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(texts without candidates, spans of the others): spans have kind, start, end (code points), base, live, n_owners, n_repos."""
    without, having = candidate_spans(docs, id_col, text_col, owner_col, repo_col)
    once = having.groupBy("id", "key", "owner", "repo").agg(F.first("found").alias("found"), F.count("*").alias("copies"))
    rows = once.select("id", "key", "owner", "repo", "copies", F.inline("found"))
    order = W.partitionBy("id", "key", "owner", "repo", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    # written before it meets the rows: both sides of the join are plain shuffles, of which Spark splits a hot value
    spans = rows.join(materialize(ownership(rows.filter("kept")), "owners"), "value", "left")
    live = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repos") <= MAX_REPOS * F.col("n_owners")) & (F.col("rich") >= MIN_DISTINCT)
    return without, spans.withColumn("base", F.col("kind") < BASE_KINDS).withColumn("live", F.coalesce(live, F.lit(False)))


def reported() -> Column:
    """Spans of the result: kept base ones, and added ones that look live; a private key always counts."""
    pem = [k for k, x in enumerate(KINDS) if x[0] == "pem"][0]
    return F.col("kept") & (F.col("base") | F.col("live") | (F.col("kind") == pem))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id") -> DataFrame:
    """Per text: n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    without, spans = secret_spans(docs, id_col, text_col, owner_col, repo_col)
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    said = F.struct("start", "kind", "end")
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.col("base") & F.col("kept")
    out = spans.groupBy("id", "key", "owner", "repo").agg(
        *(F.count_if(F.col("kept") & (F.col("kind") == k)).alias(f"n_{KINDS[k][0]}") for k in range(BASE_KINDS)),
        F.sha2(joined(F.collect_list(F.when(base, said))), 256).alias("base_sha256"),
        joined(F.collect_list(F.when(reported(), said))).alias("spans"),
        F.count_if(reported() & F.col("live")).alias("n_live"),
        F.count_if(reported() & ~F.col("live")).alias("n_example"),
        F.max("copies").alias("copies"),
    )
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    columns = [F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example"]
    zero = F.lit(0).cast("long")
    empty = without.select(F.col("id").alias(id_col), *(zero.alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), zero.alias("n_live"), zero.alias("n_example"))
    return out.select(*columns).unionByName(empty)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every reported span replaced; overlapping spans count as one."""
    _, spans = secret_spans(docs, id_col, text_col, owner_col, repo_col)
    cut = (
        spans.filter(reported())
        .groupBy("id", "key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cut"))
    )
    merged = F.aggregate(
        F.col("__cut"),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    own, key, other, spans_col = (fresh(docs, x) for x in ("__k", "__key", "__id", "__cut"))
    cut = cut.select(F.col("id").alias(other), F.col("key").alias(key), merged.alias(spans_col))
    keyed = docs.withColumn(own, text_key(id_col, text_col))
    joined = keyed.join(cut, F.col(id_col).eqNullSafe(F.col(other)) & (F.col(own) == F.col(key)), "left")
    text = F.col(text_col)
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(spans_col)),
        lambda i: F.substring(
            text,
            F.coalesce(F.get(spans_col, i - 1)["end"], F.lit(0)).cast("int") + 1,
            (F.coalesce(F.get(spans_col, i)["start"], F.length(text).cast("long")) - F.coalesce(F.get(spans_col, i - 1)["end"], F.lit(0))).cast("int"),
        ),
    )
    return joined.withColumn(text_col, F.when(F.col(spans_col).isNull(), text).otherwise(F.array_join(pieces, mark))).select(*docs.columns)
