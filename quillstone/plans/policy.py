"""Registered queries over visibility, audit events and numeric rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compliance, lexicon, providers, rbac
from ..sources import files, sinks, store
from ..sources.tables import spread
from ..sources.tables import table as _table
from ..streaming import audit
from . import search
from .indexes import HR as _HR
from .indexes import RISK as _RISK
from .indexes import documents_index, index_of
from .indexes import tagged as _tagged


def table(spark, sf, name):
    """A table; long texts of one small file are dealt over all cores."""
    df = _table(spark, sf, name)
    return spread(df) if name in ("documents", "pages") else df


def security_tag(spark, sf):
    return _tagged(spark, sf).select("doc_id", "category", F.array_join("allowed", ",").alias("allowed"))


def rbac_filter(spark, sf):
    return rbac.visible(_tagged(spark, sf), "allowed", ["Staff", "HR"]).select("doc_id", "category")


def rbac_single_role(spark, sf):
    return rbac.visible_single(_tagged(spark, sf), "allowed", "Risk_Manager").select("doc_id")


def visibility(spark, sf):
    return rbac.visibility(_tagged(spark, sf), "allowed")


def role_union(spark, sf):
    return rbac.role_union(_tagged(spark, sf), "source", "allowed").select("source", F.array_join("roles", ",").alias("roles"))


def parse_roles(spark, sf):
    raw = F.when(F.col("doc_id") % 4 == 0, '["Admin", "HR"]').when(F.col("doc_id") % 4 == 1, "Staff, Guest").when(F.col("doc_id") % 4 == 2, '"Admin"').otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.parse_roles(raw), "|").alias("plain"), F.array_join(T.parse_roles(raw, True), "|").alias("wrapped"))


def secure_bm25(spark, sf):
    ix, views = documents_index(spark, sf, "code"), lexicon.views_of(spark, {"guest": ["Guest"]})
    found = lexicon.search(ix, views, table(spark, sf, "benchmark").withColumn("view", F.lit("guest")), "item_id", T.tokenize_code(F.col("text")), 10, "code")
    return found.select("item_id", "doc_id", "score", "rank")


def _secure(spark, sf, roles) -> DataFrame:
    v, items = table(spark, sf, "embeddings"), table(spark, sf, "benchmark")
    c = search.Corpus(_tagged(spark, sf), v.select(F.col("vec_id").alias("doc_id"), "embedding"), items, v.select(F.col("vec_id").alias("item_id"), "embedding").join(items.select("item_id"), "item_id", "left_semi"), index=index_of(spark, sf))
    return search.secure_search(c, "allowed", roles, search.SearchConfig(top_k=10))


def leak_check(spark, sf):
    found = _secure(spark, sf, ["Guest"])
    return rbac.leaks(found, _tagged(spark, sf), "doc_id", "allowed", ["Guest"]).agg(F.count("*").alias("n_leaks")).crossJoin(rbac.role_only(_tagged(spark, sf), "doc_id", "allowed", ["HR"], "Guest").agg(F.count("*").alias("n_overlap")))


def rejected_by_role(spark, sf):
    found = search.lexical(search.Corpus(_tagged(spark, sf), None, table(spark, sf, "benchmark"), None, index=index_of(spark, sf)), 10)
    return rbac.rejected(found.join(_tagged(spark, sf).select("doc_id", "allowed"), "doc_id"), "allowed", "item_id", ["Guest"])


def access_decision(spark, sf):
    rows = _tagged(spark, sf).withColumn("title", F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("T"), F.col("doc_id").cast("string")))).withColumn("number", F.when(F.col("doc_id") % 3 == 0, F.lit("N")))
    return rbac.access_decisions(rows, "allowed", ["Staff"], "title", "number", "doc_id").select("doc_id", "decision", "name")


def audit_events(spark, sf):
    e = table(spark, sf, "events")
    lines = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp_utc"), F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id_demo"), F.when(F.col("event_type") == "error", "DENIED").otherwise("OK").alias("status"))
    path = store.fresh_folder(spark, "audit")
    sinks.append_audit(lines, path)
    last = files.audit_lines(spark, path, last=100)  # the log's newest hundred
    return last.select(F.col("request_id").cast("long").alias("event_id"), "timestamp_utc", F.col("user_id_demo").alias("user"), "status")


def model_refinement(spark, sf):
    """Undecided pairs go to a model (here a rule that fails for every third) until 25 answers exist."""
    rows = compliance.classify_gap(_pairs(spark, sf), "external_text", "internal_text").select("doc_id", "classification")

    def answer(row: dict) -> dict | None:
        return None if row["doc_id"] % 3 == 0 else {"refined": "DAP_UNG" if row["doc_id"] % 2 else "CHENH_LECH"}

    return providers.refine(rows, "doc_id", [F.col("doc_id")], F.col("classification") == "CHUA_DU_BANG_CHUNG", answer, "doc_id long, refined string", 25)


def query_variants(spark, sf):
    """Variants of every item, half of which were asked before; every fifth fails."""
    items = _table(spark, sf, "benchmark")
    path, settings = store.fresh_folder(spark, "answers"), {"model": "rule", "n": 3}

    def generate(text: str) -> list[str]:
        if len(text) % 5 == 0:
            raise ValueError("no answer")
        return [f"{text}?", text.split(" ", 1)[-1], text, " "]

    providers.generated(spark, path, items.filter("item_id % 2 = 0"), "item_id", "text", settings, generate)
    found = providers.generated(spark, path, items, "item_id", "text", settings, generate)
    queries = providers.query_set(items, "item_id", "text", providers.accepted_variants(found.filter("variants IS NOT NULL"), items, "item_id", "text"))
    failed = queries.filter("query_id = 'Q1' AND item_id % 7 = 0")  # searches that did not run through
    status = providers.search_status(queries, failed, "item_id").withColumnRenamed("status", "search_status")
    return found.join(status, "item_id").select("item_id", "status", "n_queries", "n_failed", "search_status")


def audit_denied(spark, sf):
    e = table(spark, sf, "events").withColumn("status", F.when(F.col("value") > 50, "DENIED").otherwise("OK"))
    out = audit.denied_counts(e, width="1 hour")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_denied", "n_events")


def redact(spark, sf):
    e = table(spark, sf, "events")
    raw = F.concat(F.lit('{"user": "u'), F.col("user_id").cast("string"), F.lit('", "api_key": "k'), F.col("event_id").cast("string"), F.lit('", "note": "'), F.when(F.col("event_id") % 3 == 0, "my password is x").otherwise("fine"), F.lit('", "n": 1}'))
    return e.select("event_id", T.redact(raw).alias("clean"))


def _policies(spark, sf, *more: str) -> DataFrame:
    d = table(spark, sf, "documents")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" tối thiểu "), (F.col("n_chars") % 20).cast("string"), F.lit(",5 %"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" không quá "), (F.col("n_chars") % 30).cast("string"), F.lit(" tỷ"))).otherwise(F.concat(F.lit(" tối đa "), (F.col("n_chars") % 40).cast("string"), F.lit("%")))
    return d.select("doc_id", *more, F.col("text").alias("body"), F.concat("text", said).alias("text"))


def threshold_extract(spark, sf):
    t = compliance.thresholds(F.col("text"))
    return _policies(spark, sf).select("doc_id", *(c.alias(n) for n, c in t.items()))


def _pairs(spark, sf) -> DataFrame:
    p = _policies(spark, sf).select("doc_id", "text")
    other = p.select((F.col("doc_id") - 3).alias("doc_id"), F.col("text").alias("internal_text"))
    return p.withColumnRenamed("text", "external_text").join(other, "doc_id", "left")


def gap_classify(spark, sf):
    return compliance.classify_gap(_pairs(spark, sf), "external_text", "internal_text").select("doc_id", "classification", "rule", "confidence", "mandate")


def conflict_classify(spark, sf):
    return compliance.classify_conflict(_pairs(spark, sf), "internal_text", "external_text").select("doc_id", "classification", "severity", "method", "confidence")


def best_match(spark, sf):
    found = compliance.match_requirements(table(spark, sf, "benchmark"), table(spark, sf, "documents"), "item_id", "doc_id", "text")
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"))


def gap_report(spark, sf):
    internal = _policies(spark, sf).select("doc_id", "text")
    external = table(spark, sf, "benchmark").select("item_id", F.concat("text", F.lit(" tối thiểu 9 %")).alias("text"))
    out = compliance.gap_report(external, internal, "item_id", "doc_id", "text")
    return compliance.class_counts(out, "classification", ["DAP_UNG", "CHENH_LECH", "THIEU", "CHUA_DU_BANG_CHUNG"])


def _two_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Policies of the unit (sources of even numbers) with their roles, and all others as external texts."""
    category = rbac.security_category(F.col("body"), F.col("source"), _HR, _RISK)
    rows = _policies(spark, sf, "source").filter("doc_id IS NOT NULL").withColumn("allowed", rbac.allowed_roles(category)).drop("body")
    own = F.coalesce(F.col("source").rlike("[02468]$"), F.lit(False))
    return rows.filter(own), rows.filter(~own)


def conflict_check(spark, sf):
    internal, external = _two_sides(spark, sf)
    out = compliance.conflict_check(internal, external, "doc_id", "doc_id", "text", ["Staff"])
    return out.select("doc_id", "matched_doc_id", F.round("score", 6).alias("score"), "classification", "severity", "method", "confidence")


def document_class(spark, sf):
    kind = F.when(F.col("doc_id") % 4 == 0, " Luật ").when(F.col("doc_id") % 4 == 1, "Quy chế nội bộ").when(F.col("doc_id") % 4 == 2, "khác")
    doc = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("agr_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    number = F.concat(F.lit("1/2024/"), F.when(F.col("doc_id") % 3 == 0, "QH15").when(F.col("doc_id") % 3 == 1, "TT-NHNN").otherwise("XX"))
    return table(spark, sf, "documents").select("doc_id", compliance.document_class(kind, doc).alias("class"), compliance.type_of_number(number).alias("type"))


def risk_level(spark, sf):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Nghiêm cấm").when(F.col("doc_id") % 3 == 1, " định kỳ").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", compliance.risk_level(text).alias("risk_level"))


def checklist(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("citation"), F.coalesce(F.col("source").rlike("[02468]$"), F.lit(False)).alias("own"))
    # sources of even numbers stand for the unit's own texts, all others for external ones
    return compliance.checklist(d.filter("own"), d.filter("NOT own"), "Cash", "KHO", "doc_id", "text", "citation").select("item_id", "risk_level", "source_citation", F.length("audit_question").alias("n_chars"))


def unknown_citations(spark, sf):
    items = table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("citation"))
    return compliance.unknown_citations(items, table(spark, sf, "documents").select(F.col("doc_id").alias("citation")), "citation")


def class_examples(spark, sf):
    return compliance.examples_per_class(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id")


_CAT = "(CASE WHEN " + " OR ".join(f"contains(hay, '{w}')" for w in _HR) + " THEN 'HR' WHEN " + " OR ".join(f"contains(hay, '{w}')" for w in _RISK) + " THEN 'RISK' ELSE 'GENERAL' END)"
_TAG = f"tagged AS (SELECT doc_id, text, source, category, CASE category WHEN 'HR' THEN ['Admin', 'HR'] WHEN 'RISK' THEN ['Admin', 'Risk_Manager', 'Staff'] ELSE ['Admin', 'HR', 'Risk_Manager', 'Staff', 'Guest'] END AS allowed FROM (SELECT doc_id, text, source, {_CAT} AS category FROM (SELECT *, lower(text || ' ' || source) AS hay FROM documents)))"
_POL = "pol AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' tối thiểu ' || (n_chars % 20) || ',5 %' WHEN 1 THEN ' không quá ' || (n_chars % 30) || ' tỷ' ELSE ' tối đa ' || (n_chars % 40) || '%' END AS text, CASE WHEN doc_id % 3 = 0 THEN (n_chars % 20) + 0.5 END AS f, CASE WHEN doc_id % 3 = 2 THEN (n_chars % 40)::DOUBLE END AS c, CASE WHEN doc_id % 3 = 1 THEN (n_chars % 30)::DOUBLE END AS a FROM documents), pairs AS (SELECT e.doc_id, e.f AS ef, i.f AS if_, e.c AS ec, i.c AS ic, e.a AS ea, i.a AS ia, i.doc_id IS NULL AS none_ FROM pol e LEFT JOIN pol i ON i.doc_id = e.doc_id + 3)"

QUERIES = {
    f.__name__: f
    for f in (
        security_tag, rbac_filter, rbac_single_role, visibility, role_union, parse_roles, secure_bm25, leak_check, rejected_by_role, access_decision, audit_events, model_refinement, query_variants, audit_denied, redact, threshold_extract,
        gap_classify, conflict_classify, best_match, gap_report, conflict_check, document_class, risk_level, checklist, unknown_citations, class_examples,
    )
}


def _conflict_sql() -> str:
    from .retrieval import _CODE, bm25_sql

    best = bm25_sql(_CODE, docs="ext", fill=False, positive=True, k=1).replace("FROM benchmark", "FROM iq")
    pol = _POL[: _POL.index(", pairs AS")]
    return f"""WITH {_TAG}, {pol}, sides AS (SELECT pol.*, coalesce(regexp_matches(source, '[02468]$'), false) AS own, list_contains(allowed, 'Staff') AS seen FROM pol JOIN tagged USING (doc_id)),
ext AS (SELECT doc_id, text FROM sides WHERE NOT own), iq AS (SELECT doc_id AS item_id, text FROM sides WHERE own AND seen), {best},
m AS (SELECT i.doc_id, l.doc_id AS matched_doc_id, score, i.f AS if_, i.c AS ic, i.a AS ia, e.f AS ef, e.c AS ec, e.a AS ea FROM (SELECT * FROM sides WHERE own AND seen) i LEFT JOIN lex l ON l.item_id = i.doc_id LEFT JOIN pol e ON e.doc_id = l.doc_id),
r AS (SELECT *, matched_doc_id IS NULL AS none_, if_ IS NOT NULL AND ef IS NOT NULL AS hf, ic IS NOT NULL AND ec IS NOT NULL AS hc, ia IS NOT NULL AND ea IS NOT NULL AS ha FROM m),
k AS (SELECT *, CASE WHEN none_ THEN false WHEN hf THEN if_ < ef WHEN hc THEN ic > ec WHEN ha THEN ia > ea ELSE false END AS clash FROM r)
SELECT doc_id, matched_doc_id, round(score, 6) AS score, CASE WHEN clash THEN 'XUNG_DOT' WHEN NOT none_ AND (hf OR hc OR ha) THEN 'KHONG_XUNG_DOT' ELSE 'CHUA_DU_BANG_CHUNG' END AS classification, CASE WHEN clash THEN 'HIGH' END AS severity, CASE WHEN none_ THEN 'no_candidate' WHEN hf THEN 'rule_numeric_floor_pct' WHEN hc THEN 'rule_numeric_ceiling_pct' WHEN ha THEN 'rule_numeric_ceiling_amount' ELSE 'rule_no_confident_match' END AS method, CASE WHEN none_ THEN 0.3 WHEN hf THEN 0.85 WHEN hc OR ha THEN 0.8 ELSE 0.35 END::DOUBLE AS confidence FROM k"""


def _checklist_sql() -> str:
    from .retrieval import _CODE, bm25_sql

    best = bm25_sql(_CODE, docs="ext", fill=False, positive=True, k=5).replace("FROM benchmark", "FROM asking")
    any_of = lambda words: " OR ".join(f"contains(lower(text), '{w}')" for w in words)
    return f"""WITH sides AS (SELECT doc_id, text, coalesce(regexp_matches(source, '[02468]$'), false) AS own FROM documents),
ext AS (SELECT doc_id, text FROM sides WHERE NOT own), asking AS (SELECT 0 AS item_id, text FROM sides WHERE own), {best},
items AS (SELECT 0 AS side, 0 AS place, doc_id, text FROM sides WHERE own UNION ALL SELECT 1, rank, doc_id, text FROM lex JOIN ext USING (doc_id)),
n AS (SELECT *, row_number() OVER (ORDER BY side, place, doc_id)::VARCHAR AS n, trim(coalesce(text, ''), ' ') AS t FROM items)
SELECT 'CHK_KHO_' || lpad(n, greatest(2, length(n))::INTEGER, '0') AS item_id, CASE WHEN {any_of(compliance.HIGH_WORDS)} THEN 'HIGH' WHEN {any_of(compliance.MEDIUM_WORDS)} THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 'c' || doc_id AS source_citation, (length('Does the unit comply with: ""?') + CASE WHEN length(t) > 220 THEN length(rtrim(substr(t, 1, 220), ' ')) + 3 ELSE length(t) END)::INTEGER AS n_chars FROM n"""


def _oracles() -> dict[str, str]:
    from .retrieval import _CODE, bm25_sql

    guest = bm25_sql(_CODE, docs="guest", fill=False, positive=True)
    best = bm25_sql(_CODE, fill=False, positive=True, k=1)
    gap = "SELECT doc_id, CASE WHEN none_ THEN 'CHUA_DU_BANG_CHUNG' WHEN ef IS NOT NULL AND if_ IS NOT NULL THEN CASE WHEN if_ >= ef THEN 'DAP_UNG' ELSE 'CHENH_LECH' END WHEN ea IS NOT NULL AND ia IS NOT NULL THEN CASE WHEN ia <= ea THEN 'DAP_UNG' ELSE 'CHENH_LECH' END ELSE 'CHUA_DU_BANG_CHUNG' END AS classification, CASE WHEN none_ THEN 'no_candidate' WHEN ef IS NOT NULL THEN 'floor_pct' WHEN ea IS NOT NULL THEN 'ceiling_amount' ELSE 'no_threshold' END AS rule, CASE WHEN none_ THEN 0.5 WHEN ef IS NOT NULL THEN CASE WHEN if_ >= ef THEN 0.85 ELSE 0.8 END WHEN ea IS NOT NULL THEN CASE WHEN ia <= ea THEN 0.8 ELSE 0.75 END ELSE 0.35 END AS confidence, false AS mandate FROM pairs"
    return {
        "security_tag": f"WITH {_TAG} SELECT doc_id, category, array_to_string(allowed, ',') AS allowed FROM tagged",
        "rbac_filter": f"WITH {_TAG} SELECT doc_id, category FROM tagged WHERE list_has_any(allowed, ['Staff', 'HR'])",
        "rbac_single_role": f"WITH {_TAG} SELECT doc_id FROM tagged WHERE list_contains(allowed, 'Risk_Manager')",
        "visibility": f"WITH {_TAG} SELECT r AS role, count(*) FILTER (list_contains(allowed, r)) AS visible, count(*) AS total FROM tagged, unnest(['Admin', 'HR', 'Risk_Manager', 'Staff', 'Guest']) u(r) GROUP BY r",
        "role_union": f"WITH {_TAG} SELECT source, array_to_string(list_sort(list_distinct(flatten(list(allowed)))), ',') AS roles FROM tagged GROUP BY source",
        "parse_roles": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Admin|HR' WHEN 1 THEN 'Staff|Guest' WHEN 2 THEN '\"Admin\"' ELSE '' END AS plain, CASE doc_id % 4 WHEN 0 THEN 'Admin|HR' WHEN 1 THEN 'Staff|Guest' WHEN 2 THEN 'Admin' ELSE '' END AS wrapped FROM documents",
        "secure_bm25": f"WITH {_TAG}, guest AS (SELECT * FROM tagged WHERE list_contains(allowed, 'Guest')), {guest} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM lex",
        "leak_check": "SELECT 0 AS n_leaks, 0 AS n_overlap",
        "rejected_by_role": f"WITH {_TAG}, {bm25_sql()} SELECT item_id, count(*) FILTER (NOT list_contains(allowed, 'Guest')) AS n_rejected FROM lex JOIN tagged USING (doc_id) GROUP BY item_id",
        "access_decision": f"WITH {_TAG} SELECT doc_id, CASE WHEN list_contains(allowed, 'Staff') THEN 'GRANTED' ELSE 'DENIED' END AS decision, CASE WHEN doc_id % 2 = 1 THEN 'T' || doc_id WHEN doc_id % 3 = 0 THEN 'N' ELSE doc_id::VARCHAR END AS name FROM tagged",
        "audit_events": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp_utc, 'u' || user_id AS \"user\", CASE WHEN event_type = 'error' THEN 'DENIED' ELSE 'OK' END AS status FROM events ORDER BY timestamp_utc DESC, event_id::VARCHAR LIMIT 100",
        "audit_denied": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (value > 50) AS n_denied, count(*) AS n_events FROM events GROUP BY 1",
        "redact": "SELECT event_id, '{\"user\": \"u' || user_id || '\", \"api_key\": \"[REDACTED]\", \"note\": \"' || CASE WHEN event_id % 3 = 0 THEN '[REDACTED-SUSPECTED-SECRET]' ELSE 'fine' END || '\", \"n\": 1}' AS clean FROM events",
        "threshold_extract": f"WITH {_POL} SELECT doc_id, f AS floor_pct, c AS ceiling_pct, a AS ceiling_amount FROM pol",
        "gap_classify": f"WITH {_POL} {gap}",
        "conflict_classify": f"WITH {_POL} SELECT doc_id, CASE WHEN none_ THEN 'CHUA_DU_BANG_CHUNG' WHEN if_ < ef OR ic > ec OR ia > ea THEN 'XUNG_DOT' ELSE 'KHONG_XUNG_DOT' END AS classification, CASE WHEN if_ < ef OR ic > ec OR ia > ea THEN 'HIGH' END AS severity, CASE WHEN none_ THEN 'rule_no_confident_match' WHEN ef IS NOT NULL THEN 'rule_numeric_floor_pct' WHEN ec IS NOT NULL THEN 'rule_numeric_ceiling_pct' ELSE 'rule_numeric_ceiling_amount' END AS method, CASE WHEN none_ THEN 0.35 WHEN ef IS NOT NULL THEN 0.85 ELSE 0.8 END AS confidence FROM pairs",
        "best_match": f"WITH {best} SELECT item_id, doc_id, round(score, 6) AS score FROM benchmark LEFT JOIN lex USING (item_id)",
        "document_class": "SELECT doc_id, CASE WHEN doc_id % 4 = 1 OR doc_id % 5 = 0 THEN 'INTERNAL_POLICY' WHEN doc_id % 4 = 0 THEN 'EXTERNAL_REQUIREMENT' ELSE 'UNKNOWN' END AS class, CASE doc_id % 3 WHEN 0 THEN 'Luật' WHEN 1 THEN 'Thông tư' END AS type FROM documents",
        "risk_level": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM documents",
        "unknown_citations": "SELECT doc_id * 2 AS citation FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
        "class_examples": "SELECT source, doc_id, example FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS example FROM documents) WHERE example <= 5",
        "checklist": _checklist_sql(),
        "model_refinement": f"WITH {_POL}, g AS ({gap}), a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM g WHERE classification = 'CHUA_DU_BANG_CHUNG' AND doc_id % 3 <> 0) SELECT g.doc_id, classification, CASE WHEN n <= 25 THEN CASE WHEN g.doc_id % 2 = 1 THEN 'DAP_UNG' ELSE 'CHENH_LECH' END END AS refined FROM g LEFT JOIN a USING (doc_id)",
        "query_variants": "WITH v AS (SELECT item_id, text, length(text) % 5 = 0 AS bad, substr(text, instr(text, ' ') + 1) AS rest FROM benchmark), n AS (SELECT *, CASE WHEN bad THEN 1 WHEN rest = text THEN 1 ELSE 2 END AS n FROM v) SELECT item_id, CASE WHEN bad THEN 'failed' WHEN item_id % 2 = 0 THEN 'cached' ELSE 'generated' END AS status, n AS n_queries, CASE WHEN n > 1 AND item_id % 7 = 0 THEN 1 ELSE 0 END AS n_failed, CASE WHEN n = 1 THEN 'single_query' WHEN item_id % 7 = 0 THEN 'multi_query_partial' ELSE 'multi_query' END AS search_status FROM n",
        "conflict_check": _conflict_sql(),
        "gap_report": f"WITH {_POL}, bq AS (SELECT item_id, text || ' tối thiểu 9 %' AS text FROM benchmark), {best.replace('FROM documents', 'FROM pol').replace('FROM benchmark', 'FROM bq')}, m AS (SELECT item_id, f FROM bq LEFT JOIN lex USING (item_id) LEFT JOIN pol USING (doc_id)), c AS (SELECT CASE WHEN f IS NULL THEN 'CHUA_DU_BANG_CHUNG' WHEN f >= 9 THEN 'DAP_UNG' ELSE 'CHENH_LECH' END AS k FROM m) SELECT k AS classification, (SELECT count(*) FROM c WHERE c.k = u.k) AS n FROM unnest(['DAP_UNG', 'CHENH_LECH', 'THIEU', 'CHUA_DU_BANG_CHUNG']) u(k)",
    }


ORACLES = _oracles()
