"""The driver's contract, with and without the optional part, and the oracle on a small scale."""

import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessella import queries as graph_queries

ROOT, SMALL = Path(__file__).resolve().parents[1], Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are elsewhere")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(graph_queries.QUERIES) <= set(entry.queries())


def test_imports_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'super_triples' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in graph_queries.ORACLE_SQL if not n.startswith("streaming")))
def test_oracle(spark, name):
    duckdb = importlib.import_module("duckdb")
    con = duckdb.connect()
    for t in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got = graph_queries.QUERIES[name](spark, str(SMALL))
    want = con.execute(graph_queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    tidy = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    assert tidy(map(tuple, got.select(*columns).collect())) == tidy(want.fetchall())


@needs_data
@pytest.mark.parametrize("name, table, exchanges, reused", [("super_triples", "events", 11, 2), ("trips_grouped", "lineitem", 12, 1), ("unique_edges", "lineitem", 14, 2)])
def test_vertices_are_read_and_deduplicated_once(spark, name, table, exchanges, reused):
    """With the vertices written, the plan reads the source for edges alone; both ends share the mapping's exchange."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = graph_queries.QUERIES[name](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (plan.count(f"{table}.parquet"), plan.count(" Exchange "), plan.count("ReusedExchange")) == (1, exchanges, reused), plan
    assert "explode" not in plan and "Python" not in plan


def test_plans_have_no_python_and_prune_columns(spark):
    if not SMALL.exists():
        pytest.skip("the driver's tables are elsewhere")
    for name in ("super_triples", "group_edges_label_property", "chained_grouping"):
        plan = graph_queries.QUERIES[name](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = graph_queries.QUERIES["agg_count"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
