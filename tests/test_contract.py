import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from vacantia.plans import registry

ROOT = Path(__file__).resolve().parent.parent
CORE = {n: f for m in registry.modules() for n, f in m.QUERIES.items()}
SQL = {n: s for m in registry.modules() for n, s in m.ORACLES.items()}
FOLDER = "/root/testdata/sf0.001"


def test_names_and_flagship(spark):
    assert set(SQL) <= set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert {r.tier: r.companies for r in entry.entry(spark).collect()} == {"A": 52, "B-attesa": 7, "B-esperienza": 42, "evidenza-mancante": 4, "scarto": 45}


def test_core_does_not_need_the_language_package():
    code = "import sys; sys.modules['vacantia.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and 'p1_found' not in e.queries() and 'p5_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def shown(v):
    return "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, duck, name):
    df = CORE[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in result.fetchall()) == got
