"""Scratch tables and rows that occur often."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, fold_copies, row_hash, scratch_root, unfold_copies


def test_no_local_folder_off_local_masters():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))
    assert scratch_root(session("local[2]"))
    for master in ("spark://host:7077", "yarn", "k8s://x"):
        with pytest.raises(ValueError):
            scratch_root(session(master))


def test_scratch_tables_go_when_dropped(spark):
    from pathlib import Path

    scratch = Scratch(spark, "test")
    tables = [scratch.put(spark.range(n)) for n in (1, 2, 3)]
    left = lambda: len(list(Path(scratch.base).iterdir()))
    assert [t.count() for t in tables] == [1, 2, 3] and left() == 3
    scratch.drop(tables[0])
    assert left() == 2
    scratch.drop_all_but(tables[2])
    assert left() == 1 and tables[2].count() == 3
    before = [spark.conf.get(k) for k in Scratch.SETTINGS]
    small = scratch.put(spark.range(5000).groupBy(F.col("id") % 100).count())
    assert small.count() == 100 and len(small.inputFiles()) == 1 and [spark.conf.get(k) for k in Scratch.SETTINGS] == before
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        scratch.put(spark.range(5).select((F.lit(1) / (F.col("id") - 2)).alias("x")))
    assert [spark.conf.get(k) for k in Scratch.SETTINGS] == before


@pytest.mark.parametrize("limit", [3, 10**6])
def test_copies_are_folded_and_unfolded(spark, limit):
    rows = spark.createDataFrame([(None, "a", {"x": 1})] * 9000 + [(1, "a", {"x": 1})] * 4 + [(2, None, None)] * 2, "id long, text string, m map<string,int>")
    keyed = rows.select(row_hash(rows, 1).alias("h1"), row_hash(rows, 2).alias("h2"), "*")
    folded, some = fold_copies(keyed, keyed.groupBy("h1", "h2").agg(F.count("*").alias("n")), limit)
    assert some == (limit == 3) and folded.count() == (4 if some else 9006)
    back = unfold_copies(folded).groupBy("id", "text").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("c")).collect()
    assert {(r.id, r.text, r.n) for r in back} == {(None, "a", 9000), (1, "a", 4), (2, None, 2)}
    assert not some or {(r.n, r.c) for r in back} == {(9000, 9000), (4, 4), (2, 1)}
