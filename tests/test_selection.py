"""Nested selection and shared fits, on tables whose answers are known."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import many_fits, models, selection


@pytest.fixture(scope="module")
def rows(spark):
    """Twelve campaigns; `late` is what decides from campaign 5 on, before that only `early` does."""
    rng = np.random.default_rng(8)
    out = []
    for c in range(1, 13):
        for h in range(150):
            early, late, noise = rng.normal(size=3)
            signal = late if c >= 5 else early
            out.append((h, c, float(early), float(late), float(noise), int(rng.random() < 1 / (1 + np.exp(1 - 2.5 * signal)))))
    path = tempfile.mkdtemp(prefix="spark-") + "/rows"
    spark.createDataFrame(out, "household_key long, campaign long, early double, late double, noise double, label int").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def campaigns(spark):
    return spark.createDataFrame([(c, 100 * c, 100 * c + 60) for c in range(1, 13)], "campaign long, start_day long, end_day long")


def path():
    return tempfile.mkdtemp(prefix="spark-") + "/predictions"


def test_fits_equal_spark_ml(spark, rows):
    fits = {"a": many_fits.Fit((1, 2, 3), ("early", "noise"), 0.01), "b": many_fits.Fit((5, 6), ("early", "late", "noise"), 0.001), "c": many_fits.Fit(tuple(range(1, 13)), ("late",), 0.1)}
    got = many_fits.fit_logistics(rows, fits, "label")
    for k, f in fits.items():
        train = rows.where(F.col("campaign").isin(list(f.campaigns)))
        from pyspark.ml.classification import LogisticRegression

        want = models.fit(train, list(f.columns), "label", LogisticRegression(regParam=f.penalty, tol=1e-12, maxIter=500), scale=True)
        a = {(r["household_key"], r["campaign"]): r["score"] for r in want.score(train).select("household_key", "campaign", "score").collect()}
        b = {(r["household_key"], r["campaign"]): r["score"] for r in many_fits.score_logistics(train, {k: got[k]}, {k: {"x": f.campaigns}}, ["household_key"]).collect()}
        assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_scans_do_not_grow_with_fits(spark, rows, monkeypatch):
    calls = []
    real = many_fits._summed
    monkeypatch.setattr(many_fits, "_summed", lambda *a: calls.append(1) or real(*a))
    many_fits.fit_logistics(rows, {0: many_fits.Fit((1, 2), ("early",))}, "label")
    one = len(calls)
    calls.clear()
    many_fits.fit_logistics(rows, {i: many_fits.Fit(tuple(range(1, i + 3)), ("early", "late")) for i in range(8)}, "label")
    assert len(calls) <= one + 4


def test_weights_count_as_rows(spark, rows):
    twice = rows.unionByName(rows.where("household_key % 3 = 0"))
    f = {0: many_fits.Fit((1, 2, 3), ("early", "noise"), 0.0)}
    a = many_fits.fit_logistics(twice, f, "label")[0]
    b = many_fits.fit_logistics(rows.withColumn("w", F.when(F.col("household_key") % 3 == 0, 2).otherwise(1)), f, "label", "w")[0]
    assert np.allclose(a.coefficients, b.coefficients, atol=1e-7) and abs(a.intercept - b.intercept) < 1e-7


def test_constant_columns_and_single_classes(spark, rows):
    x = rows.withColumn("same", F.lit(3.0))
    fits = {0: many_fits.Fit((1,), ("same", "early")), 1: many_fits.Fit((99,), ("early",))}
    got = many_fits.fit_logistics(x, fits, "label")
    assert list(got) == [0] and got[0].coefficients[0] == 0
    assert many_fits.fit_logistics(x.withColumn("label", F.lit(1)), fits, "label") == {}


CANDIDATES = {"early": selection.Candidate(0, ("early",)), "both": selection.Candidate(2, ("early", "late")), "late": selection.Candidate(1, ("late",)), "noise": selection.Candidate(0, ("noise",))}


def test_a_better_candidate_is_chosen_once_its_campaigns_have_ended(rows, campaigns):
    rules = selection.Rules(first_test_day=300, min_inner_folds=2, inner_last=3, locked=2, near=0.02)
    got = selection.nested_selection(rows, campaigns, CANDIDATES, "early", "label", rules, path())
    chosen = {f["test_campaign"]: f["chosen"] for f in got.folds}
    assert list(chosen) == list(range(3, 13))
    assert all(chosen[c] == "early" for c in (3, 4, 5)), chosen  # nothing that ended before campaign 6 shows the late column
    assert all(chosen[c] == "late" for c in (9, 10, 11, 12)), chosen
    assert [f["test_campaign"] for f in got.folds if f["locked"]] == [11, 12]
    marks = got.predictions.groupBy("campaign").agg(F.count_if("chosen").alias("c"), F.count_if("is_default").alias("d"), F.count(F.lit(1)).alias("n"), F.max("locked").alias("l")).collect()
    assert all(r["c"] == r["d"] == 150 and r["n"] == 600 and r["l"] == (r["campaign"] >= 11) for r in marks)
    # outer training sets are the first 2 to 11 campaigns, inner ones the first 1 to 10 of them: each fit is made once
    assert got.fits == len(CANDIDATES) * 11
    assert selection.recommended(got, CANDIDATES, "early", rules)[0] == "both"  # the open campaigns hold both kinds


def test_too_little_history_keeps_the_default(rows, campaigns):
    rules = selection.Rules(first_test_day=900, min_inner_folds=7, inner_last=6)
    got = selection.nested_selection(rows, campaigns, CANDIDATES, "noise", "label", rules, path())
    assert all(f["chosen"] == "noise" and not f["inner_scores"] for f in got.folds)
    rules = selection.Rules(first_test_day=900, min_inner_folds=1, min_inner_test=(10_000, 1))
    got = selection.nested_selection(rows, campaigns, CANDIDATES, "noise", "label", rules, path())
    assert all(f["chosen"] == "noise" for f in got.folds)


def test_folds_without_enough_rows_are_left_out(rows, campaigns):
    rules = selection.Rules(first_test_day=0, min_train=(700, 1))
    calendar = selection.Calendar(rows, campaigns, "label")
    assert [c for c, _ in calendar.outer(rules)] == list(range(6, 13))
    with pytest.raises(ValueError, match="finished"):
        selection.nested_selection(rows, campaigns, CANDIDATES, "early", "label", selection.Rules(first_test_day=5000), path())


def test_any_scorer_can_be_a_candidate(rows, campaigns):
    made = []

    def make(train):
        made.append(sorted(r[0] for r in train.select("campaign").distinct().collect()))
        return models.logistic(train, ["late"], "label")

    more = {"early": CANDIDATES["early"], "own": selection.Candidate(1, make=make)}
    got = selection.nested_selection(rows, campaigns, more, "early", "label", selection.Rules(first_test_day=1100, min_inner_folds=2, inner_last=2), path())
    assert [f["chosen"] for f in got.folds] == ["own", "own"]
    assert sorted(made) == sorted([list(range(1, k)) for k in (9, 10, 11, 12)])


def test_rule_of_choice():
    c = CANDIDATES
    assert selection.choose({"early": 0.5, "late": 0.501, "both": 0.6, "noise": 0.4}, c, "early", 0.002) == "both"
    assert selection.choose({"early": 0.5, "late": 0.595, "both": 0.6}, c, "early", 0.002, 0.01) == "late"
    assert selection.choose({"early": 0.5, "late": 0.501}, c, "early", 0.002) == "early"
    assert selection.choose({"early": None, "late": 0.9}, c, "early", 0.002) == "early"


def test_a_planted_pair_of_columns_enters_first(rows):
    from basketry.operators import column_sets as s

    groups = {"noise": ["noise"], "pair": ["early", "late"], "early": ["early"]}
    folds = [(12, [5, 6, 7, 8, 9, 10]), (4, [1, 2, 3])]
    curve = s.add_one_curve(rows, folds, groups, "label")
    assert [c["step"] for c in curve] == [1, 2, 3] and curve[0]["added"] == "pair" and curve[0]["gain"] is None and curve[1]["gain"] < 0.02
    assert curve[0]["tried"]["pair"] > curve[0]["tried"]["early"] > curve[0]["tried"]["noise"]
    change = {r["dropped"]: r["change"] for r in s.ablation(rows, folds, {"noise": ["noise"], "late": ["late"], "early": ["early"]}, "label").collect()}
    assert change["none"] == 0 and change["late"] < -0.05 and change["early"] < -0.05 and abs(change["noise"]) < 0.05


def test_importance_is_that_of_the_columns_that_decide(rows):
    from basketry.operators import column_sets as s

    drop = {r["feature"]: r["drop"] for r in s.permutation_importance(rows, [(11, [5, 6, 7, 8]), (12, [5, 6, 7, 8])], ["early", "late", "noise"], "label", draws=3).collect()}
    assert drop["late"] > 0.1 and abs(drop["early"]) < 0.06 and abs(drop["noise"]) < 0.06


def test_a_model_for_each_group_of_campaigns(rows):
    from basketry.operators import column_sets as s, metrics

    got = s.by_group(rows, {"old": (1, 2, 3), "new": (5, 6, 7)}, {"old": (4,), "new": (8, 9)}, ["early", "late"], "label")
    auc = {r["campaign"]: r["auc"] for r in metrics.auc(got, "score", "label", ["campaign"]).collect()}
    assert set(auc) == {4, 8, 9} and min(auc.values()) > 0.8
