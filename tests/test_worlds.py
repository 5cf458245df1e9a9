"""Lines meet cutoffs before products, and the worlds of the leak test are cut to their windows before lines are dealt."""

import numpy as np
from pyspark.sql import functions as F

import basketry.plans.catalog  # noqa: F401  (first: it imports the queries)
from basketry.operators import health, many_fits, profile, spine
from basketry.plans import binding

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_lines_look_for_products_once_they_have_met_cutoffs(spark):
    # a plan's upper lines run last
    t = binding.tables(spark, SF)
    text = plan(profile._lines(t, profile.cutoffs(spine.grid(t))))
    household = [i for i, x in enumerate(text) if "Join [household_key" in x]
    product = [i for i, x in enumerate(text) if "Join [product_id" in x]
    assert household and product and min(product) < min(household)


def test_a_worlds_lines_are_cut_to_their_window_where_they_are_repeated(spark):
    t, seen = binding.tables(spark, SF), []

    def build(tables, rows):
        seen.append((tables, rows))
        return rows.withColumn("x", F.lit(1))

    assert [tuple(r) for r in health.leak_test(t, build, ["x"]).collect()] == [("x", 0)]
    worlds = next(x for x in seen if "cutoff_day" in x[0].transactions.columns)
    assert any("NestedLoopJoin" in x and "182" in x for x in plan(profile._lines(*worlds)))


def test_lines_that_know_their_only_cutoff_give_the_same_profile(spark):
    t = binding.tables(spark, SF)
    day = t.campaigns.where("campaign = 9").first()["start_day"]
    rows = profile.cutoffs(spine.grid(t).where("campaign = 9"))
    known = t.with_(transactions=t.transactions.withColumn("cutoff_day", F.lit(day)), mailings=t.mailings.withColumn("cutoff_day", F.lit(day)))
    got, want = profile.profiles(known, rows), profile.profiles(t, rows)
    assert got.columns == want.columns and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_sums_of_fits_on_the_same_columns_are_those_of_each_alone():
    draw = np.random.default_rng(3)
    a = np.column_stack((np.ones(50), draw.normal(size=(50, 4))))
    y, w, betas = draw.integers(0, 2, 50).astype(float), draw.uniform(0.5, 2, 50), draw.normal(size=(5, 6))
    got = many_fits._sums_of_fits(a, y, w, betas)
    for b, found in zip(betas.T, got, strict=True):
        p = 1 / (1 + np.exp(-(a @ b)))
        hessian = (a.T * (w * p * (1 - p))) @ a
        want = np.concatenate(([w.sum(), (w * y).sum(), -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()], a.T @ (w * (p - y)), hessian[np.triu_indices(5)]))
        assert np.allclose(found, want, rtol=1e-12)
