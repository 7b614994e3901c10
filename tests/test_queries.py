"""Every query of the library against its SQL on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vesperflow.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in got.columns) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in rows) == want


def test_crossmatch_summary_orders_no_pairs_in_one_task(spark, duck, monkeypatch):
    from vesperflow.operators import robust

    monkeypatch.setattr(robust, "WHOLE", 10)  # as with many pairs
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = registry.QUERIES["crossmatch_summary"](spark, SF)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("percentile(", "median(", "SortMergeJoin") if x in plan]
        row = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = duck.execute(registry.ORACLE_SQL["crossmatch_summary"])
    names = [d[0] for d in found.description]
    assert [tuple(map(plain, (r[c] for c in names))) for r in row] == [tuple(map(plain, r)) for r in found.fetchall()]


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["cell", "median", "mad", "n", "brightest"]


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/vesperflow", tmp_path / "vesperflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'region_cone' in n and not [x for x in n if x.startswith('op') or x == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
