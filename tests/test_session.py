from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tapeline.session import materialize, settled, shared_dir


def folders(spark):
    base = os.path.dirname(shared_dir(spark, "x"))
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_settled_keeps_its_result_only(spark):
    before = folders(spark)

    def make():
        a = materialize(spark.range(10), "a")
        inner = settled(lambda: materialize(a.where("id > 2"), "b").where("id > 3"), "inner")
        return inner.join(a, "id")

    out = settled(make, "out")
    assert sorted(r.id for r in out.collect()) == [4, 5, 6, 7, 8, 9]
    assert [x.split("-")[0] for x in folders(spark) - before] == ["out"]


def test_settled_after_a_failure(spark):
    before = folders(spark)

    def make():
        return materialize(spark.range(3), "a").withColumn("x", F.raise_error(F.lit("no")))

    with pytest.raises(Exception):
        settled(make, "out")
    assert {x.split("-")[0] for x in folders(spark) - before} <= {"out"}
    kept = materialize(spark.range(2), "kept")
    assert kept.count() == 2
