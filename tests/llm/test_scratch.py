"""Scratch: where it lies, and that it goes."""

from types import SimpleNamespace

import pytest

from cdfloom.llm import common


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(session)


def test_released_scratch_leaves_no_files_and_no_tables(spark):
    with common.scratch_owner("test"):
        frame = common.materialize(spark.range(10), "some")
        table = common.bucketed(spark.range(10).withColumnRenamed("id", "k"), "some", "k")
        assert frame.count() == table.count() == 10
    (name,) = common._tables["test"]
    paths = list(common._owned["test"])
    assert spark.catalog.tableExists(name)
    common.release(spark, "test")
    assert not spark.catalog.tableExists(name) and len(paths) == 2
    for p in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(p)
        assert not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def test_joins_on_a_bucketed_tables_columns_do_not_move_it(spark):
    table = common.bucketed(spark.range(1000).selectExpr("id as k", "repeat('x', 50) as t"), "dealt", "k")
    plan = table.hint("merge").join(spark.range(10).withColumnRenamed("id", "k"), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
