"""Text functions as column expressions. Everything stays in the JVM but Unicode composition and exact case folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches must equal the established ones.
LEGAL_TOKEN = r"([\p{L}\p{N}]+)"
CODE_TOKEN = r"([0-9a-zA-ZÀ-ỹ]+(?:[/\-][0-9a-zA-ZÀ-ỹ]+)*)"
ARTICLE_REF = r"điều\s+(\d+[a-zà-ỹ]?)"
LEGAL_REFS = [r"(điều\s+\d+[a-zđ]?)", r"(khoản\s+\d+)", r"(điểm\s+[a-zđ])(?![\p{L}\p{N}])"]
CITED = r"\[((?:E|P)\d+)\]"


def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x or ""))


def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x or "").casefold())


def nfc(c: Column) -> Column:
    """Unicode NFC, null as empty. Spark has no builtin: an Arrow UDF."""
    return F.pandas_udf(_compose, "string")(F.coalesce(c, F.lit("")))


def casefold(c: Column) -> Column:
    """NFC and full case folding (ß as ss), by an Arrow UDF; lower() is the native near equivalent."""
    return F.pandas_udf(_fold, "string")(F.coalesce(c, F.lit("")))


def tokenize_legal(c: Column, exact: bool = False) -> Column:
    """Runs of letters and digits, lower-cased. exact: NFC and case folding first; native otherwise (differs for ß only on NFC text)."""
    return F.regexp_extract_all(casefold(c) if exact else F.lower(F.coalesce(c, F.lit(""))), F.lit(LEGAL_TOKEN), F.lit(1))


def tokenize_code(c: Column) -> Column:
    """Article references first (điều_N), then tokens that keep inner / and -, each followed by its parts of two and more characters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    refs = F.transform(F.regexp_extract_all(low, F.lit(ARTICLE_REF), F.lit(1)), lambda n: F.concat(F.lit("điều_"), n))
    parts = lambda t: F.when(t.rlike(r"[/\-]"), F.concat(F.array(t), F.filter(F.split(t, r"[/\-]"), lambda p: F.length(p) >= 2))).otherwise(F.array(t))
    return F.concat(refs, F.flatten(F.transform(F.regexp_extract_all(low, F.lit(CODE_TOKEN), F.lit(1)), parts)))


def squeeze(c: Column) -> Column:
    """Each run of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_for_dedupe(c: Column) -> Column:
    """Lower case, punctuation as space, squeezed: texts that agree are the same variant."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]", " "))


def legal_refs(c: Column) -> Column:
    """Distinct references to articles, clauses and points, squeezed and lower-cased, sorted."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.flatten(F.array(*(F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in LEGAL_REFS)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda r: F.regexp_replace(r, r"\s+", " "))))


def normalize_text(c: Column) -> Column:
    """Line ends as \\n, no zero-width characters, blanks squeezed, lines trimmed, at most one empty line in a row."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n|[\r\f\x0b]", "\n")
    t = F.regexp_replace(F.regexp_replace(t, " ", " "), "[​‌‍﻿]", "")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), " ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\n+|\n+$", ""))


def heading_of(c: Column) -> Column:
    """First line without a trailing dot or colon."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"^([^\n]*)", 1), r"[.:]+\s*$", "")


def snippet(c: Column, length: int) -> Column:
    """The first characters, with an ellipsis where more follow."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > length, F.concat(F.rtrim(F.substring(c, 1, length)), F.lit("..."))).otherwise(c)


def page_range(start: Column, end: Column) -> Column:
    """'p. 3' or 'p. 3-5'."""
    return F.when(start == end, F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("p. "), start.cast("string"), F.lit("-"), end.cast("string")))


def rank_arrow(before: Column, after: Column) -> Column:
    """How a rank moved."""
    moved = before - after
    return F.when(moved > 0, F.concat(F.lit("↑"), moved.cast("string"))).when(moved < 0, F.concat(F.lit("↓"), (-moved).cast("string"))).otherwise(F.lit("="))


def cited_labels(c: Column) -> Column:
    """Labels [E1], [P2] in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITED), F.lit(1)))


def drop_labels(c: Column, invalid: Column) -> Column:
    """The text without the labels of an array, squeezed."""
    cut = F.aggregate(invalid, c, lambda text, label: F.replace(text, F.concat(F.lit("["), label, F.lit("]")), F.lit("")))
    return squeeze(cut)


def strip_reasoning(c: Column) -> Column:
    """A model's answer without <think> parts and code fences, ready for from_json."""
    no_think = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(no_think, r"(?m)^```(?:json)?|```$", ""))


def sigmoid(c: Column) -> Column:
    """1 / (1 + exp(-x)); the JVM's exp saturates, so no overflow."""
    return 1 / (1 + F.exp(-c))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The array at unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def parse_roles(c: Column, wrap_scalar: bool = False) -> Column:
    """Roles from a JSON array or a comma list; wrap_scalar: a JSON string is one role."""
    listed = F.from_json(c, "array<string>")
    commas = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    out = F.coalesce(F.when(F.trim(c).startswith("["), listed), commas)
    if wrap_scalar:
        out = F.when(F.trim(c).rlike(r'^".*"$'), F.array(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"))).otherwise(out)
    return out


def redact(c: Column) -> Column:
    """JSON text whose secret-looking keys and values are replaced, at any depth, as text: keys first, then string values."""
    secret = r"(?i:api[_-]?key|password|secret|token|bearer\s)"
    keyed = F.regexp_replace(c, rf'("[^"]*{secret}[^"]*"\s*:\s*)(?:"(?:[^"\\]|\\.)*"|\[[^\[\]]*\]|\{{[^{{}}]*\}}|[^,}}\]\s]+)', r'$1"[REDACTED]"')
    return F.regexp_replace(keyed, rf'"(?:[^"\\]|\\.)*{secret}(?:[^"\\]|\\.)*"(?!\s*:)', '"[REDACTED-SUSPECTED-SECRET]"')


def citation(title: Column, number: Column, article: Column, clause: Column, chunk: Column) -> Column:
    """Title, number (where the title lacks it), article with a numeric clause, chunk id; empty parts are left out."""
    where = F.when(article != "", F.concat(F.lit("Điều "), article, F.when(clause.rlike(r"^\d+$"), F.concat(F.lit(" khoản "), clause)).otherwise("")))
    return F.concat_ws(" | ", F.nullif(title, F.lit("")), F.when((number != "") & ~F.contains(title, number), number), where, chunk)


def index_text(parts: list[Column], article: Column, body: Column) -> Column:
    """What is indexed for a chunk: a header of the parts that are not empty and its article, then the text on a line of its own."""
    filled = [F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts]
    header = F.trim(F.concat_ws(" ", *filled, F.when(F.coalesce(article, F.lit("")) != "", F.concat(F.lit("Điều "), article))))
    return F.when(header != "", F.concat(header, F.lit("\n"), body)).otherwise(body)


#: Code points of a quoted chunk.
QUOTED = 400


def quotation(citation_text: Column, text: Column, most: int = QUOTED) -> Column:
    """One line of an extractive answer: the citation and the text's beginning as it stands."""
    flat = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    said = F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))).otherwise(flat)
    return F.concat(F.lit("- ["), citation_text, F.lit("] "), said)
