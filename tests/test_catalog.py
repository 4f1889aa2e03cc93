"""Every registered query outside the language-model subpackage against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries without SQL and the tests that hold them against brute force.
TESTED = {"checklist": "test_checklist.py", "split_clauses": "test_documents.py", "html_blocks": "test_documents.py", "seeded_sample": "test_answers.py", "html_text": "test_answers.py", "hierarchical_modes": "test_answers.py", "final_parents": "test_answers.py"}


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, int):
        return str(v)
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(f) else str(int(f)) if f == int(f) else f"{f:.6g}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert name in TESTED, f"{name} has neither SQL nor a test of its own"
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())
