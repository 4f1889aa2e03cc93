import json

from pyspark.sql import functions as F

from quillstone.operators import chunking, graph, hierarchy, html, rbac, validation
from quillstone.operators.compliance import classify_conflict, classify_gap
from quillstone.sources import files, sinks


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "x" * 800), (2, "y" * 801), (3, ""), (4, " " * 10)], "id int, text string")
    got = [(r["id"], r["n"], r["start"], r["end"]) for r in chunking.fixed_chunks(docs, "id", "text").orderBy("id", "n").collect()]
    assert got == [(1, 1, 0, 800), (2, 1, 0, 800), (2, 2, 680, 801)]


def test_semantic_and_tiny(spark):
    docs = spark.createDataFrame([(1, "a" * 600 + "\n\n" + "12" + "\n\n" + "b" * 500)], "id int, text string")
    got = [r["text"] for r in chunking.semantic_chunks(docs, "id", "text").orderBy("n").collect()]
    assert got == ["a" * 600 + "\n\n12", "b" * 500]


def test_hierarchical(spark):
    text = "mở đầu\nChương I\nĐiều 1. Tên\n1. một\na) điểm\n2. hai\nChương II\nĐiều 2. Khác"
    docs = spark.createDataFrame([(1, text), (2, "không có gì")], "id int, text string")
    got = [(r["id"], r["path"], r["detected"]) for r in chunking.hierarchical_chunks(docs, "id", "text").orderBy("id", "n").collect()]
    assert [p for i, p, _ in got if i == 1] == ["Chương I", "Chương I > Điều 1", "Chương I > Điều 1 > Khoản 1", "Chương I > Điều 1 > Khoản 1 > Điểm a)", "Chương I > Điều 1 > Khoản 2", "Chương II", "Chương II > Điều 2"]
    assert got[-1] == (2, None, False)


def test_split_clauses(spark):
    body = "Điều 1. X\n" + "\n".join(f"{i}. " + "w" * 1500 for i in (1, 2, 3))
    docs = spark.createDataFrame([(1, body), (2, "short"), (3, "H\n" + "z" * 7000)], "id int, text string")
    got = [(r["id"], r["clause"]) for r in chunking.split_clauses(docs, ["id"], "text").orderBy("id", "part").collect()]
    assert got == [(1, "1"), (1, "2"), (1, "3"), (2, ""), (3, "p1"), (3, "p2"), (3, "p3")]


def test_parent_windows_count_gaps_only_when_held(spark):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([298, 300, 10, 700])], "g int, i int, text string")
    got = {r["i"]: r["window"] for r in hierarchy.parent_windows(rows, ["g"], [F.col("i").alias("o")], "i", "text", 600).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3}


def test_budget_skips_and_keeps_first(spark):
    rows = spark.createDataFrame([(1, "a", 1, 900), (1, "b", 2, 50), (2, "a", 1, 60), (2, "b", 2, 50), (2, "c", 3, 40)], "q int, p string, r int, n int")
    got = {(r["q"], r["p"]): r["selected"] for r in hierarchy.context_budget(rows, "q", "p", "r", "n", 100).collect()}
    assert got == {(1, "a"): True, (1, "b"): False, (2, "a"): True, (2, "b"): False, (2, "c"): True}


def test_html_blocks_and_tree(spark):
    page = "<div><h1>Chương I</h1><h2>Điều 1. A &amp; B</h2><p>1. một</p><script>x</script><table><tr><td>a</td><td>b</td></tr></table></div>"
    assert html.html_blocks_of(page) == [("Chương I", False), ("Điều 1. A & B", False), ("1. một", False), ("a | b", True)]
    rows = html.blocks(spark.createDataFrame([("d", page), ("e", None)], "doc string, html string"), "doc", "html")
    tree = html.heading_tree(rows, "doc").orderBy("order_index").collect()
    assert [r["level"] for r in tree] == ["chuong", "dieu", "khoan", "bang"]
    assert [r["parent_id"] for r in tree] == [None, tree[0]["chunk_id"], tree[1]["chunk_id"], tree[2]["chunk_id"]]
    assert html.markdown_to_html_of("# A\n**b** & c\n<table>\n<tr>\n</table>") == "<h1>A</h1>\n<p>b &amp; c</p>\n<table>\n<tr>\n</table>"


def test_load_chunks(spark):
    rows = spark.createDataFrame([("a", "fixed_size", "s", 1, 2, "x"), ("a", "fixed-size", "s", 1, 2, "y"), ("b", "fixed-size", "s", 0, 2, "z"), ("c", "fixed-size", "s", 1, 1, " "), ("d", "fixed-size", "s", 1, 1, "ok"), ("e", "semantic", "s", 1, 1, "no")], "chunk_id string, strategy string, source string, page_start int, page_end int, text string")
    valid, stats = validation.load_chunks(rows, "fixed-size")
    assert [r["chunk_id"] for r in valid.collect()] == ["d"] and tuple(stats.first()) == (5, 1, 1, 2, 1)


def test_json_csv_and_stores(spark, tmp_path):
    chunk = {"chunk_id": "a", "strategy": "semantic", "source": "s", "page_start": 1, "page_end": 1, "text": "t"}
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps([chunk]))
    (tmp_path / "j/b.json").write_text(json.dumps({"chunks": [dict(chunk, chunk_id="b")]}))
    assert sorted(r["chunk_id"] for r in files.json_chunks(spark, str(tmp_path / "j")).collect()) == ["a", "b"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_bytes("﻿x,y\n1,\"a\nb\"\n".encode())
    (tmp_path / "c/b.csv").write_bytes("x,y\n2,é\n".encode("latin-1"))
    assert sorted((r["x"], r["y"]) for r in files.csv_any_encoding(spark, str(tmp_path / "c"), ["x", "y"]).collect())[0] == ("1", "a\nb")
    store = str(tmp_path / "store")
    assert sinks.store_state(spark, store, {"v": 1}) == "missing"
    sinks.write_store({"t": spark.range(3).toDF("id")}, store, {"v": 1})
    assert sinks.store_state(spark, store, {"v": 1}) == "ready" and sinks.store_state(spark, store, {"v": 2}) == "stale"


def test_upsert(spark):
    known = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, text string, source string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "c", "z")], "id int, text string, source string")
    assert sorted(map(tuple, sinks.upsert(known, new, "id").collect())) == [(1, "a", "x"), (2, "B", "Y"), (3, "c", "z")]
    assert sorted(map(tuple, sinks.upsert(known, new, "id", only=["text"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z")]


def test_rbac_fails_closed(spark):
    rows = spark.createDataFrame([(1, ["Admin"]), (2, None), (3, []), (4, [None]), (5, ["Guest", None])], "id int, allowed array<string>")
    assert [r["id"] for r in rbac.visible(rows, "allowed", ["Guest"]).collect()] == [5]
    hits = spark.createDataFrame([(1,), (5,), (99,)], "id int")
    assert sorted(r["id"] for r in rbac.leaks(hits, rows, "id", "allowed", ["Guest"]).collect()) == [1, 99]


def test_rules(spark):
    rows = spark.createDataFrame([("tối thiểu 8,5 %", "ít nhất 9%"), ("tối thiểu 10%", "tối thiểu 9 %"), ("không quá 5 tỷ", "tối đa 6 tỷ"), ("x", "y"), ("x", None)], "e string, i string")
    assert [(r["classification"], r["confidence"]) for r in classify_gap(rows, "e", "i").collect()] == [("DAP_UNG", 0.85), ("CHENH_LECH", 0.8), ("CHENH_LECH", 0.75), ("CHUA_DU_BANG_CHUNG", 0.35), ("CHUA_DU_BANG_CHUNG", 0.5)]
    assert [r["method"] for r in classify_conflict(rows, "e", "i").collect()] == ["rule_numeric_floor_pct", "rule_numeric_floor_pct", "rule_numeric_ceiling_amount", "rule_no_confident_match", "no_candidate"]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "K"), ("b", "c", "K"), ("c", "d", "K")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("b",)], "seed string")
    assert sorted((r["node"], r["hop"]) for r in graph.neighbours(edges, seeds, 2).collect()) == [("a", 1), ("c", 1), ("d", 2)]
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "id int, up int")
    assert sorted((r["id"], r["root"], r["depth"]) for r in graph.ancestors(chain, "id", "up", 8).collect()) == [(i, 0, i) for i in range(9)]


def test_stream_counts(spark, tmp_path):
    from quillstone.streaming.audit import audit_stream, denied_counts

    (tmp_path / "in").mkdir()
    lines = [{"timestamp_utc": f"2024-01-01T00:{m:02d}:00", "request_id": str(m), "status": "DENIED" if m % 2 else "OK"} for m in range(20)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)))
    q = denied_counts(audit_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("denied").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n_denied"], r["n_events"]) for r in spark.sql("SELECT * FROM denied").collect()) == [(5, 10), (5, 10)]


def test_whole_texts_are_searched_and_compared(spark, tmp_path):
    import re

    from quillstone.plans import documents

    rows = [(1, "x" * 300 + " Điều 12b, khoản 7"), (2, "khoản  5 " + "y " * 5000 + "điểm đ"), (3, "Điều 1 " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in rows:
        low = f"{t} theo Điều  {i % 20}a, khoản {i % 4} và điều 3 điểm b.".lower()
        want[i] = ",".join(sorted({re.sub(r"\s+", " ", x) for x in re.findall(r"điều\s+\d+[a-zđ]?|khoản\s+\d+|điểm\s+[a-zđ]", low)}))
    assert {r["doc_id"]: r["refs"] for r in documents.legal_refs(spark, str(tmp_path)).collect()} == want
    same = "the same words in the first sixty characters of every variant, "
    turns = [(1, 0, "what is asked"), (1, 1, "replaced"), (1, 2, same + "first"), (1, 4, same + "second"), (1, 5, same + "first"), (1, 7, "z" * 401)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r["status"] for r in documents.variant_filter(spark, str(tmp_path)).collect()}
    assert got == {1: "duplicate", 2: "accepted", 4: "accepted", 5: "duplicate", 7: "length"}
