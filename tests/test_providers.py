"""Model calls by waves, stored answers, search statuses and the audit stream."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import providers
from quillstone.sources import files, sinks, store
from quillstone.streaming import audit


def sequential(ids, good, budget, attempts=None):
    out = []
    for n, i in enumerate(sorted(ids)):
        if len(out) == budget or n == attempts:
            break
        if good(i):
            out.append(i)
    return out


@pytest.mark.parametrize(("good", "budget", "attempts"), [(lambda i: i % 3 == 0, 5, None), (lambda i: i > 40, 4, None), (lambda i: i == 59, 3, None), (lambda i: False, 3, None), (lambda i: True, 100, None), (lambda i: i % 2 == 0, 6, 7), (lambda i: True, 0, None)])
def test_waves_answer_what_one_after_another_would(spark, good, budget, attempts):
    def answer(row):
        if not good(row["id"]):
            raise ValueError("no answer")
        return {"said": f"a{row['id']}"}

    rows = spark.range(80).withColumn("open", F.col("id") < 60)
    got = providers.refine(rows, "id", [F.col("id")], F.col("open"), answer, "id long, said string", budget, attempts)
    assert got.count() == 80
    assert sorted(r["id"] for r in got.filter("said IS NOT NULL").collect()) == sequential(range(60), good, budget, attempts)


def test_only_new_prompts_are_asked(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def generate(text):
        (log / f"{abs(hash(text))}-{len(list(log.iterdir()))}").write_text(text)
        if "bad" in text:
            raise RuntimeError("down")
        return [text + " again", text.upper(), "", text + "  AGAIN"]

    asked = lambda: sorted(x.read_text() for x in log.iterdir())
    path, settings = f"{tmp_path}/answers", {"model": "m", "temperature": 0}
    q = spark.createDataFrame([(1, "one"), (2, "two"), (3, "bad"), (4, "one")], "q long, text string")
    found = {r["q"]: r["status"] for r in providers.generated(spark, path, q, "q", "text", settings, generate).collect()}
    assert found == {1: "generated", 2: "generated", 3: "failed", 4: "generated"} and asked() == ["bad", "one", "two"]  # a prompt once
    again = providers.generated(spark, path, q.union(spark.createDataFrame([(5, "five")], q.schema)), "q", "text", settings, generate)
    assert {r["q"]: r["status"] for r in again.collect()} == {1: "cached", 2: "cached", 3: "failed", 4: "cached", 5: "generated"}
    assert asked() == ["bad", "bad", "five", "one", "two"]
    other = providers.generated(spark, path, q, "q", "text", settings | {"temperature": 1}, generate)  # other settings are other prompts
    assert {r["status"] for r in other.collect()} == {"generated", "failed"}
    accepted = providers.accepted_variants(found_rows := again.filter("variants IS NOT NULL"), q, "q", "text").collect()
    assert sorted((r["q"], r["text"]) for r in accepted) == [(1, "one again"), (2, "two again"), (4, "one again")] and found_rows.count() == 4


def test_search_statuses(spark):
    queries = spark.createDataFrame([(1, "Q0"), (2, "Q0"), (2, "Q1"), (3, "Q0"), (3, "Q1"), (3, "Q2")], "q long, query_id string")
    failed = spark.createDataFrame([(3, "Q2")], queries.schema)
    got = {r["q"]: (r["n_queries"], r["n_failed"], r["status"]) for r in providers.search_status(queries, failed, "q").collect()}
    assert got == {1: (1, 0, "single_query"), 2: (2, 0, "multi_query"), 3: (3, 1, "multi_query_partial")}
    with pytest.raises(Exception, match="original query failed: 2"):
        providers.search_status(queries, spark.createDataFrame([(2, "Q0")], queries.schema), "q").collect()


def lines(folder, name, ids):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"timestamp_utc": f"2024-05-01T10:00:{i:02d}", "request_id": f"r{i}", "user_id_demo": "u", "action": "ask", "status": "OK"}) for i in ids))


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    lines(tmp_path / "in", "a.json", [1, 2, 2, 3])
    path, checkpoint = f"{tmp_path}/log", f"{tmp_path}/checkpoint"
    run = lambda: audit.append_stream(audit.audit_stream(spark, f"{tmp_path}/in"), path, checkpoint).awaitTermination(60)
    run()
    ids = lambda: [r["request_id"] for r in files.audit_lines(spark, path).collect()]
    assert ids() == ["r3", "r2", "r1"]  # a request once, newest first
    rows = spark.read.schema(audit.LINE).json(f"{tmp_path}/in").dropDuplicates(["request_id"]).withColumn("ts", F.lit(None))
    audit.write_batch(rows, 0, path)  # as after a failure
    assert ids() == ["r3", "r2", "r1"]
    lines(tmp_path / "in", "b.json", [3, 4])
    run()
    assert ids() == ["r4", "r3", "r2", "r1"]
    assert [r["request_id"] for r in files.audit_lines(spark, path, last=2).collect()] == ["r4", "r3"]


def test_appended_lines_are_read_back(spark, tmp_path):
    path = f"{tmp_path}/log"
    for i in (1, 2):
        sinks.append_audit(spark.createDataFrame([(f"2024-05-01T10:00:0{i}", f"r{i}")], "timestamp_utc string, request_id string"), path)
    assert [r["request_id"] for r in files.audit_lines(spark, path).collect()] == ["r2", "r1"]
