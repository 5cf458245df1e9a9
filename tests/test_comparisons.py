"""Uplift metrics and comparisons of scores, by hand and by seeded data with a known answer."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import metrics, models

UPLIFT = "campaign long, household_key long, t long, y long, s double"


def qini_by_rows(rows):
    """One campaign, best first: gains at each row with the whole campaign's arms, less the straight line, by trapezoids."""
    n, n_t, n_c = len(rows), sum(t for t, _ in rows), sum(1 - t for t, _ in rows)
    q, got_t, got_c = [], 0, 0
    for t, y in rows:
        got_t, got_c = got_t + t * y, got_c + (1 - t) * y
        q.append(got_t - got_c * n_t / n_c)
    g = [v - (i + 1) / n * q[-1] for i, v in enumerate(q)]
    return sum((a + b) / 2 / n for a, b in zip(g, g[1:], strict=False))


def test_qini_scales_controls_by_the_whole_campaign(spark):
    rows = [(1, 1), (0, 0), (1, 0), (0, 1), (1, 1), (1, 0), (0, 1)]
    d = spark.createDataFrame([(1, i, t, y, -float(i)) for i, (t, y) in enumerate(rows)], UPLIFT)
    r = metrics.qini(d, "s", "y", "t", ["campaign"]).first()
    assert r["qini"] == pytest.approx(qini_by_rows(rows)) and r["treated"] == 4


def test_qini_of_ties_is_that_of_all_orders(spark):
    from itertools import permutations

    tied = [(1, 1), (0, 1), (1, 0)]
    want = [qini_by_rows([(1, 0), *p, (0, 0)]) for p in permutations(tied)]
    d = spark.createDataFrame([(1, 0, 1, 0, 9.0), *[(1, i + 1, t, y, 5.0) for i, (t, y) in enumerate(tied)], (1, 9, 0, 0, 1.0)], UPLIFT)
    assert metrics.qini(d, "s", "y", "t", ["campaign"]).first()["qini"] == pytest.approx(sum(want) / len(want))


def uplift_rows(n=3000, campaigns=3):
    rng = random.Random(0)
    out = []
    for i in range(n):
        x, t = rng.random(), int(rng.random() < 0.5)
        out.append((rng.randrange(campaigns), i, t, int(rng.random() < 0.1 + 0.3 * x * t), x))
    return out


def test_stratified_qini_rewards_the_right_order_and_weights_leave_out_rows_outside_of_overlap(spark):
    d = spark.createDataFrame(uplift_rows(), UPLIFT).withColumns({"ipw_weight": F.lit(2.0), "in_overlap": F.col("household_key") % 2 == 0, "back": -F.col("s")})
    one = lambda x, s="s", **k: metrics.stratified_qini(x, s, "y", "t", **k).first()[0]
    assert one(d) > 0.01 and one(d, "back") < -0.01
    assert one(d, weighted=True) == pytest.approx(one(d.where("in_overlap"))) and one(d.withColumn("t", F.lit(0).cast("long"))) is None


def test_gaps_of_arms_do_not_cancel_and_constants_count_as_zero(spark):
    rows = [(c, i, i % 2, (1.0 if (i % 2) == (c % 2) else 0.0) + (i // 2 % 2) * 0.5) for c in (1, 2) for i in range(60)]
    d = spark.createDataFrame(rows, "campaign long, household_key long, t long, x double").withColumns({"w": F.lit(1.0), "flat": F.lit(3.0)})
    got = {r["covariate"]: r["smd"] for r in metrics.balance(d, ["x", "flat"], "w", "t").collect()}
    sd = (0.0625 * 30 / 29) ** 0.5
    assert got == {"x": pytest.approx(1 / sd), "flat": 0.0}


def test_weights_are_one_over_the_chance_of_what_happened(spark):
    d = spark.createDataFrame([(1, 0.25), (0, 0.25), (1, 0.99)], "t long, p double")
    assert [(r["ipw_weight"], r["in_overlap"]) for r in metrics.ipw(d, "p", "t").collect()] == [(4.0, True), (pytest.approx(4 / 3), True), (pytest.approx(1 / 0.99), False)]


def test_a_better_score_is_seen_by_all_comparisons(spark):
    d = spark.createDataFrame([(c, 100 * c + i, 10 * c, int(i % 5 == 0), float(i % 5 == 0) + i / 1000, float(i % 7)) for c in range(4) for i in range(50)], "campaign long, household_key long, start_day long, y long, good double, poor double")
    gaps = {r["measure"]: r for r in metrics.measure_gaps(d, "good", "poor", "y", 20).collect()}
    assert set(gaps) == set(metrics.MEASURES) and all(r["low"] > 0 and r["gap_over_spread"] == pytest.approx(r["gap"] / r["spread"]) for r in gaps.values())
    r = metrics.paired_gap(d, "good", "poor", "y", 20).first()
    assert r["campaigns"] == r["campaigns_better"] == 4 and r["auc_low"] > 0 and r["auc_gap_early"] == pytest.approx(r["auc_gap_late"])
    worse = metrics.campaign_bootstrap(d.withColumns({"p": F.col("y") + 0.1, "b": F.col("y") + 0.3}), "p", "b", "y", 50).first()
    assert worse["diff"] == pytest.approx(-0.2) and worse["ci_high"] == pytest.approx(-0.2) and worse["share_better"] == 1.0


def test_learners_recover_a_planted_signal_and_effect(spark):
    rng = random.Random(5)
    rows = [(i % 4, i, "A" if i % 4 == 0 else "B", x := rng.random(), rng.random(), t := int(rng.random() < 0.5), int(rng.random() < 0.1 + 0.6 * x * t)) for i in range(3000)]
    d = spark.createDataFrame(rows, "campaign long, household_key long, campaign_type string, x double, noise double, t long, y long").withColumn("p", F.lit(0.5))
    d = d.repartition(4).cache()
    forest = models.forest(d, ["x", "noise"], "y")
    reliance = models.importances(forest)
    assert reliance["x"] > reliance["noise"] and metrics.auc(forest.score(d), "score", "y").first()["auc"] > 0.65
    drops = {r["feature"]: r["drop"] for r in models.permutation_importance(models.logistic(d, ["x", "noise"], "y"), d, ["x", "noise"], "y").collect()}
    assert drops["x"] > 0.05 and drops["x"] > 3 * abs(drops["noise"])
    for made in (models.x_learner(d, d, ["x"], "y", "t", "p"), models.dr_learner(d, d, ["x"], "y", "t", "p")):
        low, high = made.agg(F.avg(F.when(F.col("x") < 0.2, F.col("uplift"))), F.avg(F.when(F.col("x") > 0.8, F.col("uplift")))).first()
        assert abs(low - 0.06) < 0.08 and abs(high - 0.54) < 0.12
    change = {r["dropped"]: r["change"] for r in models.ablation(d, d, {"signal": ["x"], "rest": ["noise"]}, lambda a, f: models.logistic(a, f, "y"), "y").collect()}
    assert change["none"] == 0 and change["signal"] < -0.05
    assert {r["feature"]: r["direction"] for r in models.single_feature_rank(d, d, ["x"], "y").collect()} == {"x": "higher"}
    d.unpersist()


def test_totals_line_adds_up(spark):
    d = spark.createDataFrame([(float(i), 2.0 * i + (50 if i % 4 == 0 else 0)) for i in range(1, 41)], "x double, y double")
    slope, intercept, scale = models.median_totals(d, "x", "y")
    total = models.scored_line(d, "x", slope * scale, intercept * scale, "p").agg(F.sum("p"), F.sum("y")).first()
    assert slope == pytest.approx(2, abs=0.05) and scale > 1.1 and total[0] == pytest.approx(total[1])
