"""Registered queries do as much work as the reference does."""

import __spark_entry__ as e
from basketry.operators import metrics

SF = "/root/testdata/sf0.001"


def test_bootstrap_capture_takes_300_draws(spark, monkeypatch):
    asked, made = [], metrics.draw_counts
    monkeypatch.setattr(metrics, "draw_counts", lambda *a: asked.append(a[-2]) or made(*a))
    assert e.queries()["bootstrap_capture"](spark, SF).columns[-1] == "verdict"
    assert asked == [300] and "range(1, 300 + 1)" in e.oracle_sql()["bootstrap_capture"]


def test_a_forest_has_300_trees(spark):
    from basketry.operators import models

    d = spark.createDataFrame([(float(i % 7), float(i % 11), int(i % 7 > 3)) for i in range(80)], "a double, b double, y long").repartition(2).cache()
    assert models.forest(d, ["a", "b"], "y").model.stages[-1].getNumTrees == 300
