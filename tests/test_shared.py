"""Tables in the shared folder."""

from types import SimpleNamespace

import pytest

from rastrel import shared


def held(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def test_scope_deletes_what_was_made(spark):
    with shared.scope(spark) as keep:
        a, b = (shared.table(spark, spark.range(5), "t") for _ in range(2))
        paths = shared._made[-2:]
        keep.append(paths[1])
        assert a.count() == b.count() == 5
    assert [held(spark, p) for p in paths] == [False, True]
    assert b.count() == 5


def test_bucketed_leaves_no_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with shared.bucketed(spark, spark.range(100).selectExpr("id", "id % 7 k"), "b", "k", 3) as (t, plain):
        assert t.count() == 100
        assert "Exchange" not in t.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert {t.name for t in spark.catalog.listTables()} == before and plain.count() == 100


def test_settings_stay_as_they_were(spark):
    old = spark.conf.get(shared.CLEANUP, None)
    shared.table(spark, spark.range(5), "t")
    assert spark.conf.get(shared.CLEANUP, None) == old


@pytest.mark.parametrize(("master", "ok"), [("local[8]", True), ("local", True), ("yarn", False), ("local-cluster[3,2,1024]", False)])
def test_a_cluster_needs_a_shared_folder(master, ok):
    s = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    if ok:
        assert shared.new_path(s, "x").startswith("file:///")
    else:
        with pytest.raises(RuntimeError):
            shared.new_path(s, "x")
