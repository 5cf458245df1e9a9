"""Exact quantiles without a task that has a whole group's values, and the outlier queries that use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from basketry.operators import outliers

SF = "/root/testdata/sf0.001"
SHARES = [0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999, 0.0, 1.0]


def steps(text):
    return [x for x in text.splitlines() if "percentile(" in x]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_those_of_percentile(spark, seed):
    r = np.random.default_rng(seed)
    rows = [("many", float(v)) for v in r.lognormal(9, 2, 40_000)] + [("tied", float(v)) for v in r.integers(1, 4, 5_000)] + [("one", 7.0)] + [("few", float(v)) for v in r.normal(size=int(r.integers(2, 12)))] + [("few", None), ("none", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {x["g"]: x for x in outliers.quantiles(d, "v", ["g"], [(s, None) for s in SHARES]).collect()}
    want = {x["g"]: x for x in d.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).where("n > 0").collect()}
    assert set(got) == set(want) and all(got[g]["n"] == want[g]["n"] and got[g]["q"] == want[g]["q"] for g in want)
    logs = outliers.quantiles(d.where("v > 0"), "v", ["g"], [(0.25, F.ln)]).where("g = 'many'").first()["q"][0]
    assert logs == d.where("v > 0 and g = 'many'").agg(F.percentile(F.ln("v"), 0.25)).first()[0]


def test_a_range_that_misses_its_quantile_stops_the_query(spark, monkeypatch):
    monkeypatch.setattr(outliers, "MARGIN", -0.2)  # between ranges that are empty
    d = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("g"))
    with pytest.raises(Exception, match="outside of the range"):
        outliers.quantiles(d, "v", ["g"], [(0.5, None)]).collect()


def test_no_task_has_the_values_of_a_whole_field(spark):
    # percentile() keeps every distinct value of its group in one task; medians of a product are the only ones left
    for name in ("log_iqr_fences", "outlier_level", "outlier_sensitivity", "corrected_values", "flag_stats", "qty_typo", "disc_sign_typo"):
        plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not steps(plan), name


def test_lines_with_what_is_usual_are_stored_once(spark):
    kept = []
    lines = spark.createDataFrame([(i % 3, 1 + i % 5, 100 + i, -i, 0) for i in range(60)], "product_id long, quantity long, sales_cents long, retail_disc_cents long, coupon_disc_cents long")
    got = outliers.line_flags(lines, lambda df, name: kept.append(name) or df.localCheckpoint())
    assert kept == ["usual"] and got.count() == 60


def test_merge_reads_stored_lines_and_levels(spark, monkeypatch):
    from basketry.plans import queries_candidates

    kept, stored = [], queries_candidates.stored
    monkeypatch.setattr(queries_candidates, "stored", lambda df, name: kept.append(name) or stored(df, name))
    assert e.queries()["flag_merge"](spark, SF).count() == 1
    assert sorted(kept) == ["levels", "lines", "usual"]
