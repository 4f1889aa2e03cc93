"""Credentials of any length."""

from quillstone.llm import secret_scan


def test_passwords_in_addresses_of_any_length(spark):
    rows = [(n, f"see postgres://{'u' * n}:{'aB3xZ9' * n}@host/db now", f"s{n}") for n in (1, 12, 200)]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {n: f"urlauth:4:{4 + 11 + n + 1 + 6 * n + 1}" for n, _, _ in rows}
    assert [r["text"] for r in secret_scan.redact_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).orderBy("doc_id").collect()] == ["see [SECRET]host/db now"] * 3
