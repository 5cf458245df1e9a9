"""A fitted propensity takes a confounder out; checks that find what is planted."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from basketry.operators import integrity, metrics, models

from test_retail import t  # noqa: F401


def test_confounded_effect_is_recovered_with_the_fitted_propensity_only(spark):
    """x drives both the mailing and the outcome; the mailing itself adds 0.1."""
    rng, out = np.random.default_rng(4), []
    for h in range(6000):
        x, noise = rng.normal(size=2)
        mailed = int(rng.random() < 1 / (1 + np.exp(-1.5 * x)))
        out.append((h, int(h % 4), float(x), float(noise), mailed, int(rng.random() < min(0.95, max(0.0, 0.4 + 0.15 * x + 0.1 * mailed)))))
    df = spark.createDataFrame(out, "household_key long, campaign long, x double, noise double, mailed_flag long, label long")
    fitted = models.propensity(df, ["x", "noise"], "mailed_flag")
    path = tempfile.mkdtemp(prefix="spark-") + "/p"
    fitted.write.parquet(path)
    p = spark.read.parquet(path)
    assert p.count() == len(out)
    assert p.where("propensity < 0.02 or propensity > 0.98").isEmpty()

    def effect(weighted):
        w = F.col("ipw_weight") if weighted else F.lit(1.0)
        r = metrics.ipw(p, "propensity", "mailed_flag", 0.02, 0.98).groupBy("mailed_flag").agg((F.sum(w * F.col("label")) / F.sum(w)).alias("rate"))
        rate = {x["mailed_flag"]: x["rate"] for x in r.collect()}
        return rate[1] - rate[0]

    assert abs(effect(True) - 0.1) < 0.04 < 0.08 < abs(effect(False) - 0.1)


def test_each_household_has_a_propensity_of_models_that_never_saw_it(spark):
    """The treatment equals a household's own noise-free flag that only its own rows show: out of fold, it cannot be known."""
    rng = np.random.default_rng(5)
    rows = [(h, 1, float(h), int(rng.random() < 0.5)) for h in range(1500)]
    df = spark.createDataFrame(rows, "household_key long, campaign long, x double, mailed_flag long")
    got = models.propensity(df, ["x"], "mailed_flag")
    area = metrics.auc(got, "propensity", "mailed_flag").first()["auc"]
    assert 0.43 < area < 0.57


def test_mailed_type_is_held_against_the_campaigns(spark, t):  # noqa: F811
    assert integrity.checks(t)["X6"][2].first()["n_rows"] == 0  # mailings without a type
    mailings = spark.createDataFrame([(1, 1, "B"), (2, 1, "A"), (1, 2, "C"), (3, 3, None)], "household_key long, campaign long, mailed_type string")
    assert integrity.checks(t.with_(mailings=mailings))["X6"][2].first()["n_rows"] == 1


def test_lines_of_over_a_hundred_pieces_are_flagged(t):  # noqa: F811
    lines = lambda n: t.transactions.limit(1).withColumn("quantity", F.lit(n).cast("long"))
    many = t.with_(transactions=lines(41).union(lines(100)).union(lines(101)).union(lines(5000)))
    assert integrity.checks(many)["Q7"][2].first()["n_rows"] == 2
