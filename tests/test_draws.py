"""Draws of clusters: rows are not repeated for them, a digest is made once, and sums are those of the repeated rows."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import metrics

from test_queries import test_query_gives_the_rows_of_its_sql as gives_the_rows_of_its_sql

NAMES = ["measure_gaps", "paired_gap", "cluster_bootstrap", "bootstrap_capture", "campaign_bootstrap"]


def rows(spark):
    made = [(i % 40 if i % 17 else None, i % 3 if i % 13 else None, i % 2 if i % 11 else None, (i % 5) / 4 if i % 7 else None, float("nan") if i % 19 == 0 else -0.0 if i % 2 else 0.0) for i in range(400)]
    return spark.createDataFrame(made, "household_key long, campaign long, y long, a double, b double").repartition(3)


@pytest.mark.parametrize("cluster", [["household_key"], ["household_key", "campaign"]])
@pytest.mark.parametrize("vectors", [3, 20_000])
def test_sums_of_draws_are_those_of_repeated_rows(spark, cluster, vectors, monkeypatch):
    monkeypatch.setattr(metrics, "VECTORS", vectors)
    d = rows(spark)
    got = metrics.draw_counts(d, ["a", "b"], "y", ["campaign"], cluster, 12, 5)
    x = metrics.resampled(d, cluster, 12, 5).select("rep", "campaign", "multiplicity", "y", F.expr("stack(2, 'a', a, 'b', b) AS (ranking, s)"))
    want = x.groupBy("rep", "ranking", "campaign", "s").agg(F.sum("multiplicity").cast("long").alias("n"), F.sum(F.col("multiplicity") * F.col("y")).alias("pos"))
    assert got.count() == want.count() > 0 and got.exceptAll(want.select(*got.columns)).isEmpty()
    assert metrics.draw_counts(d.limit(0), ["a", "b"], "y", ["campaign"], cluster, 12, 5).isEmpty()


def test_a_digest_is_made_once_for_a_cluster_and_draw(spark):
    d = rows(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(metrics.resampled(d, ["household_key"], 5, 1)).count("md5(") == 1
    for df in (metrics.measure_gaps(d, "a", "b", "y", 5), metrics.bootstrap_capture(d, "a", "b", "y", ["household_key"], 5), metrics.paired_gap(d.withColumn("start_day", F.lit(1)), "a", "b", "y", 5)):
        assert "md5(" not in plan(df)  # rows are not repeated


@pytest.mark.parametrize("name", NAMES)
def test_draws_give_the_rows_of_their_sql(spark, name):
    gives_the_rows_of_its_sql(spark, name)
