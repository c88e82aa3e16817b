"""Plans hold no cross joins, nested loops or row-at-a-time Python, even where nothing may be broadcast."""

import contextlib
import io

import pytest

from waylark.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def without_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield spark
    spark.conf.set(name, before)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_plan(without_broadcast, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        catalog.QUERIES[name](without_broadcast, DATA).explain()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in out.getvalue()
    if "SinglePartition" in out.getvalue():  # a total over partial sums
        assert "partial_" in out.getvalue()


def test_scans_are_pruned_and_filtered(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        catalog.QUERIES["support_leak"](spark, DATA).explain("formatted")
    text = out.getvalue()
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<c_custkey:bigint>" in text
