"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from notewright.plans import oracles
from notewright.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels conversations".split()
ORACLES = oracles.build()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, duck, name):
    df = REGISTRY[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert got, "no rows"
    if name not in ORACLES:
        return
    described = {r[0]: r[1] for r in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert described == {f.name: TYPES[f.dataType.simpleString()] for f in df.schema}
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()
    assert in_order(got) == in_order(want)


def test_only_alignment_scores_lack_sql():
    assert set(REGISTRY) - set(ORACLES) == {
        "rouge_l", "meteor_exact", "section_rouge", "sweep_report_aligned", "full_report",
    }
    assert set(ORACLES) <= set(REGISTRY)


def test_entry_has_all_of_them():
    assert set(REGISTRY) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
