"""Role-based visibility: tagging, filtering before any scoring, statistics, leak checks, access decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles, keywords of the two restricted categories and who may see what.
ROLES = ["Admin", "HR", "Risk_Manager", "Staff", "Guest"]
DEFAULT_ROLE = "Guest"
HR_WORDS = ["nhân sự", "tiền lương", "lương", "thưởng", "khen thưởng", "tuyển dụng", "bổ nhiệm", "miễn nhiệm", "kỷ luật lao động", "kỷ luật cán bộ", "người quản lý", "hội đồng quản trị", "ban kiểm soát", "tổng giám đốc"]
RISK_WORDS = ["tín dụng", "rủi ro", "hạn mức", "phê duyệt cấp tín dụng", "cấp tín dụng", "nợ xấu", "dự phòng rủi ro", "phân loại nợ", "an toàn vốn", "giới hạn cấp tín dụng", "thu hồi nợ"]
ALLOWED = {"HR": ["Admin", "HR"], "RISK": ["Admin", "Risk_Manager", "Staff"], "GENERAL": ROLES}


def any_word(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w.lower())) for w in words])


def security_category(text: Column, title: Column, hr: list[str] = HR_WORDS, risk: list[str] = RISK_WORDS) -> Column:
    """HR before RISK before GENERAL, by words anywhere in text or title."""
    hay = F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))
    return F.when(any_word(hay, hr), "HR").when(any_word(hay, risk), "RISK").otherwise("GENERAL")


def allowed_roles(category: Column) -> Column:
    roles = lambda c: F.array(*map(F.lit, ALLOWED[c]))
    return F.when(category == "HR", roles("HR")).when(category == "RISK", roles("RISK")).otherwise(roles("GENERAL"))


def validate_roles(roles: list[str], known: list[str] = ROLES) -> list[str]:
    """Trimmed, each once, in order; an unknown or no role is an error."""
    out = list(dict.fromkeys(r.strip() for r in roles if r and r.strip()))
    if not out or set(out) - set(known):
        raise ValueError(f"unknown or missing roles: {sorted(set(out) - set(known))}")
    return out


def overlaps(allowed: Column, roles: list[str]) -> Column:
    """Whether any role is allowed; null or empty lists and null roles deny."""
    return F.coalesce(F.arrays_overlap(F.filter(allowed, lambda r: r.isNotNull()), F.array(*map(F.lit, roles)).cast("array<string>")), F.lit(False))


def visible(rows: DataFrame, allowed: str, roles: list[str]) -> DataFrame:
    """Rows that any of the roles may see."""
    return rows.filter(overlaps(F.col(allowed), validate_roles(roles)))


def visible_single(rows: DataFrame, allowed: str, role: str | None) -> DataFrame:
    """Rows of one role; no role given: no filter (as established; callers decide)."""
    return rows.filter(F.coalesce(F.array_contains(allowed, role), F.lit(False))) if role else rows


def visibility(rows: DataFrame, allowed: str, roles: list[str] = ROLES) -> DataFrame:
    """role, visible, total."""
    counted = rows.agg(F.count("*").alias("total"), *(F.count_if(overlaps(F.col(allowed), [r])).alias(r) for r in roles))
    return counted.unpivot(["total"], roles, "role", "visible").select("role", "visible", "total")


def role_union(rows: DataFrame, doc: str, allowed: str) -> DataFrame:
    """Per document all roles of its rows, sorted."""
    each = rows.select(doc, F.explode_outer(allowed).alias("role")).groupBy(doc).agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return each


def rejected(candidates: DataFrame, allowed: str, query_key: str, roles: list[str]) -> DataFrame:
    """Per query: candidates that the roles may not see."""
    return candidates.groupBy(query_key).agg(F.count_if(~overlaps(F.col(allowed), roles)).alias("n_rejected"))


def leaks(hits: DataFrame, rows: DataFrame, key: str, allowed: str, roles: list[str]) -> DataFrame:
    """Hits that the roles may not see or that are unknown: must be empty."""
    known = rows.select(key, F.col(allowed).alias("__allowed"))
    return hits.join(known, key, "left").filter(~overlaps(F.col("__allowed"), roles)).drop("__allowed")


def post_filter(hits: DataFrame, rows: DataFrame, key: str, allowed: str, roles: list[str]) -> DataFrame:
    """Hits that are known and permitted; an unknown one is denied."""
    return hits.join(visible(rows, allowed, roles).select(key), key, "left_semi")


def role_only(rows: DataFrame, key: str, allowed: str, inside: list[str], outside: str) -> DataFrame:
    """Keys that only the first roles and not the other may see: with the other's own view the intersection must be empty."""
    own = rows.filter(overlaps(F.col(allowed), inside) & ~overlaps(F.col(allowed), [outside])).select(key)
    return own.intersect(visible(rows, allowed, [outside]).select(key))


def access_decisions(rows: DataFrame, allowed: str, roles: list[str], title: str, number: str, doc: str) -> DataFrame:
    """GRANTED or DENIED with the best name there is: title, number, id."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    return rows.withColumn("decision", F.when(overlaps(F.col(allowed), roles), "GRANTED").otherwise("DENIED")).withColumn("name", F.coalesce(blank(title), blank(number), blank(doc)))
