"""Permutation importance against captures worked out row by row."""

import numpy as np
from pyspark.sql import functions as F

from basketry.operators import column_sets
from basketry.operators.many_fits import Fit, fit_logistics

COLUMNS, DRAWS, FOLDS = ["signal", "flag", "noise"], 2, [(3, (1, 2)), (4, (1, 2)), (5, (1, 2, 3))]


def captured(scores, y):
    """Positives in the top fifth, ties at its border by expectation."""
    k, caught = max(1.0, float(np.round(len(y) * 0.2))), 0.0
    for s in np.unique(scores)[::-1]:
        here, above = scores == s, (scores > s).sum()
        caught += y[here].sum() * max(0.0, min(here.sum(), k - above)) / here.sum()
    return caught


def test_captures_are_those_of_all_scores(spark):
    r = np.random.default_rng(5)
    rows = [(int(h), c, float(x), float(f), float(n), int(r.random() < 1 / (1 + np.exp(2 - x - f)))) for c in range(1, 6) for h, x, f, n in zip(range(700), r.normal(size=700).round(1), r.integers(0, 2, 700), r.integers(0, 3, 700), strict=True)]
    d = spark.createDataFrame(rows, "household_key long, campaign long, signal double, flag double, noise double, label long").repartition(5).cache()
    got = {x["feature"]: (x["drop"], x["spread"]) for x in column_sets.permutation_importance(d, FOLDS, COLUMNS, "label", DRAWS).collect()}
    lines = fit_logistics(d, {t: Fit(t, tuple(COLUMNS), 0.01) for _, t in FOLDS}, "label")
    part = F.pmod(F.xxhash64(F.lit(1), "household_key"), F.lit(column_sets.EXCHANGED))
    parts = {}
    for x in d.withColumn("part", part).orderBy("campaign", "part", "household_key").collect():
        parts.setdefault((x["campaign"], x["part"]), []).append(([x[c] for c in COLUMNS], x["label"]))
    caught, total = np.zeros(1 + DRAWS * len(COLUMNS)), 0
    for test, train in FOLDS:
        of_place, y = {}, []
        for (c, p), members in parts.items():
            if c == test:
                y += [m[1] for m in members]
                for place, scores in column_sets._exchanged_scores(np.array([m[0] for m in members]), lines[train], DRAWS, (1, c, p, 0)):
                    of_place.setdefault(place, []).extend(scores)
        caught += [captured(np.array(of_place[i]), np.array(y)) for i in range(len(caught))]
        total += sum(y)
    of = (caught / total)[1:].reshape(DRAWS, len(COLUMNS))
    for i, c in enumerate(COLUMNS):
        assert np.allclose(got[c], ((caught[0] / total - of[:, i]).mean(), of[:, i].std()), atol=1e-12), c
    assert got["signal"][0] > got["flag"][0] > abs(got["noise"][0])


def test_a_column_takes_the_values_of_other_rows_of_its_part():
    from basketry.operators.many_fits import Line

    x = np.array([[1.0, 10.0], [2.0, 10.0], [3.0, 20.0], [4.0, 20.0]])
    scores = dict(column_sets._exchanged_scores(x, Line(("a", "b"), np.array([0.0, 0.1]), 0.0), 1, (1,)))
    assert sorted(scores) == [0, 1, 2] and np.array_equal(scores[0], scores[1])  # a has no say
    assert sorted(scores[2]) == sorted(scores[0])  # b is exchanged, not drawn


def test_no_row_is_repeated_for_a_column_or_a_draw(spark):
    d = spark.createDataFrame([(h, c, float(h % 5), (h + c) % 3 // 2) for c in (1, 2, 3) for h in range(40)], "household_key long, campaign long, x double, label long").cache()
    plan = column_sets.permutation_importance(d, [(3, (1, 2))], ["x"], "label")._jdf.queryExecution().executedPlan().toString()
    assert "explode(" not in plan and "Union" not in plan
