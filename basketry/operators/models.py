"""Models as Spark ML pipelines. Trees, scaling and penalties are Spark's; scores are comparable, not equal, to other libraries'."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCHANGE_PARTS = 64
FOREST = {"numTrees": 300, "maxDepth": 6, "minInstancesPerNode": 20, "seed": 42}


def signed_log(column: str) -> Column:
    return F.signum(F.col(column)) * F.log1p(F.abs(F.col(column)))


@dataclass
class Scorer:
    """A fitted pipeline that adds one column of scores."""

    model: PipelineModel
    features: list[str]
    logs: bool = False
    probability: bool = True

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        x = df.withColumns({f"_x_{c}": (signed_log(c) if self.logs else F.col(c).cast("double")) for c in self.features})
        out = self.model.transform(x)
        value = vector_to_array("probability")[1] if self.probability else F.col("prediction")
        made = ["_x", "_scaled", "rawPrediction", "probability", "prediction", *[f"_x_{c}" for c in self.features]]
        return out.withColumn("_score", value).drop(*[c for c in made if c in out.columns]).withColumnRenamed("_score", name)


def fit(df: DataFrame, features: list[str], label: str, learner, logs: bool = False, scale: bool = False, weight: str | None = None) -> Scorer:
    x = df.withColumns({f"_x_{c}": (signed_log(c) if logs else F.col(c).cast("double")) for c in features} | {"_y": F.col(label).cast("double")})
    stages = [VectorAssembler(inputCols=[f"_x_{c}" for c in features], outputCol="_x")]
    if scale:
        stages.append(StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True))
    learner = learner.setFeaturesCol("_scaled" if scale else "_x").setLabelCol("_y")
    if weight:
        learner = learner.setWeightCol(weight)
    return Scorer(Pipeline(stages=[*stages, learner]).fit(x), features, logs, hasattr(learner, "getProbabilityCol") and not isinstance(learner, LinearRegression))


def forest(df, features, label, **more) -> Scorer:
    return fit(df, features, label, RandomForestClassifier(**FOREST), **more)


def logistic(df, features, label, penalty: float = 0.001, l1: float = 0.0, logs: bool = False, **more) -> Scorer:
    return fit(df, features, label, LogisticRegression(regParam=penalty, elasticNetParam=l1), logs=logs, scale=True, **more)


def boosted(df, features, label, **more) -> Scorer:
    return fit(df, features, label, GBTClassifier(maxIter=20, maxDepth=3, seed=42), **more)


def regressor(df, features, label, kind: str = "forest", **more) -> Scorer:
    learner = {
        "forest": lambda: RandomForestRegressor(**FOREST), "boosted": lambda: GBTRegressor(maxIter=20, maxDepth=3, lossType="absolute", seed=42), "linear": LinearRegression,
        "huber": lambda: LinearRegression(loss="huber"), "ridge": lambda: LinearRegression(regParam=1.0), "tweedie": lambda: GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0),
    }[kind]()
    return fit(df, features, label, learner, logs=kind == "tweedie", **more)


def line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept, as one row."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def median_line(df: DataFrame, x: str, y: str, rounds: int = 25) -> tuple[float, float]:
    """Least-absolute-deviations slope and intercept, by reweighted sums: each round is one aggregate of all rows."""
    slope, intercept = line(df, x, y).first()
    for _ in range(rounds):
        w = 1 / F.greatest(F.abs(F.col(y) - (F.col(x) * slope + intercept)), F.lit(1e-6))
        s = df.select(w.alias("w"), F.col(x).alias("x"), F.col(y).alias("y")).agg(*[F.sum(F.col("w") * e) for e in (F.lit(1), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y"))]).first()
        sw, sx, sy, sxx, sxy = s
        d = sw * sxx - sx * sx
        slope, intercept = (sw * sxy - sx * sy) / d, (sy * sxx - sx * sxy) / d
    return slope, intercept


def scored_line(df: DataFrame, x: str, slope, intercept, name: str) -> DataFrame:
    return df.withColumn(name, F.greatest(F.lit(0.0), F.col(x) * slope + intercept))


def propensity(df: DataFrame, features: list[str], treatment: str, folds: int = 5, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """df with `propensity`, each household scored by a model that never saw it, cut to the overlap from low to high."""
    fold = F.pmod(F.xxhash64("household_key"), F.lit(folds))
    x, parts = df.withColumn("_fold", fold), []
    for k in range(folds):
        model = boosted(x.where(F.col("_fold") != k), [*features, "campaign"], treatment)
        parts.append(model.score(x.where(F.col("_fold") == k), "propensity"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("propensity", F.greatest(F.lit(low), F.least(F.lit(high), "propensity"))).drop("_fold")


def t_learner(train: DataFrame, test: DataFrame, features: list[str], label: str, treatment: str, weight: str | None = None) -> DataFrame:
    """test with p_treated, p_control and their difference, uplift."""
    treated, control = (forest(train.where(F.col(treatment) == k), features, label, weight=weight) for k in (1, 0))
    return control.score(treated.score(test, "p_treated"), "p_control").withColumn("uplift", F.col("p_treated") - F.col("p_control"))


def x_learner(train: DataFrame, test: DataFrame, features: list[str], label: str, treatment: str, propensity_column: str) -> DataFrame:
    """Effects imputed in each arm from the other arm's model, regressed, and combined by the propensity."""
    treated, control = (forest(train.where(F.col(treatment) == k), features, label) for k in (1, 0))
    d1 = control.score(train.where(F.col(treatment) == 1), "_p").withColumn("_d", F.col(label) - F.col("_p"))
    d0 = treated.score(train.where(F.col(treatment) == 0), "_p").withColumn("_d", F.col("_p") - F.col(label))
    tau1, tau0 = regressor(d1, features, "_d"), regressor(d0, features, "_d")
    both = tau0.score(tau1.score(test, "_t1"), "_t0")
    p = F.col(propensity_column)
    return both.withColumn("uplift", p * F.col("_t0") + (1 - p) * F.col("_t1")).drop("_t0", "_t1")


def dr_learner(train: DataFrame, test: DataFrame, features: list[str], label: str, treatment: str, propensity_column: str) -> DataFrame:
    """Doubly robust pseudo-outcomes regressed on the features."""
    both = t_learner(train, train, features, label, treatment)
    t, y, p = F.col(treatment), F.col(label), F.col(propensity_column)
    pseudo = F.col("p_treated") - F.col("p_control") + t * (y - F.col("p_treated")) / p - (1 - t) * (y - F.col("p_control")) / (1 - p)
    return regressor(both.withColumn("_d", pseudo), features, "_d").score(test, "uplift")


def entropy_weights(df: DataFrame, columns: list[str], treatment: str, rounds: int = 50, tolerance: float = 1e-8) -> DataFrame | None:
    """Control rows with weights that sum to one and give the treated rows' means; None where no weights can. Each Newton step sums over all control rows in Spark and solves a system of len(columns) on the driver."""
    means = df.agg(*[F.avg(F.when(F.col(treatment) == 1, F.col(c))).alias(c) for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    z = [(F.col(c) - means[c]) / (means[f"s_{c}"] or 1.0) for c in columns]
    control, k = df.where(F.col(treatment) != 1), len(columns)
    theta = np.zeros(k)

    def sums(theta):
        w = F.exp(-sum((float(a) * x for a, x in zip(theta, z, strict=True)), F.lit(0.0)))
        r = control.agg(F.sum(w), *[F.sum(w * x) for x in z], *[F.sum(w * z[i] * z[j]) for i in range(k) for j in range(i, k)]).first()
        total, first = r[0], np.array(r[1 : 1 + k]) / r[0]
        second = np.zeros((k, k))
        second[np.triu_indices(k)] = np.array(r[1 + k :]) / r[0]
        return np.log(total), first, second + np.triu(second, 1).T - np.outer(first, first)

    value, gradient, hessian = sums(theta)
    for _ in range(rounds):
        if np.abs(gradient).max() < tolerance:
            w = F.exp(-sum((float(a) * x for a, x in zip(theta, z, strict=True)), F.lit(0.0)) - float(value))
            return control.withColumn("entropy_weight", w)
        step, size = np.linalg.lstsq(hessian + 1e-12 * np.eye(k), gradient, rcond=None)[0], 1.0
        while size > 1e-6:
            new = sums(theta + size * step)
            if new[0] <= value + 1e-12:
                break
            size /= 2
        theta, (value, gradient, hessian) = theta + size * step, new
        if np.abs(theta).max() > 50:
            return None
    return None


def forward_predict(table: DataFrame, folds: list[tuple[int, list[int]]], candidates: dict, label: str, parallelism: int = 8) -> DataFrame:
    """Long predictions: every candidate, (train) -> Scorer, on every fold (test campaign, training campaigns).

    Folds with the same training campaigns share one fit; fits are submitted side by side, as small ones leave most of a cluster idle.
    """
    tasks = {(name, tuple(sorted(train))): make for _, train in folds for name, make in candidates.items()}
    with ThreadPoolExecutor(parallelism) as pool:
        fitted = dict(zip(tasks, pool.map(lambda k: tasks[k](table.where(F.col("campaign").isin(list(k[1])))), tasks), strict=True))
    out = None
    for test, train in folds:
        for name in candidates:
            rows = fitted[name, tuple(sorted(train))].score(table.where(F.col("campaign") == test)).select("household_key", "campaign", F.col(label).alias("label"), "score", F.lit(name).alias("candidate_id"))
            out = rows if out is None else out.unionByName(rows)
    return out


def choose_candidate(scores: DataFrame, default: str, least_gain: float, near: float = 0.0) -> DataFrame:
    """The default, unless another (candidate_id, score, complexity) gains enough; among those near the best, the simplest."""
    base = scores.where(F.col("candidate_id") == default).select(F.col("score").alias("_base"))
    best = scores.agg(F.max("score").alias("_best"))
    x = scores.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(best))  # one row each
    good = x.where((F.col("candidate_id") == default) | ((F.col("score") - F.col("_base") >= least_gain) & (F.col("score") >= F.col("_best") - near)))
    return good.orderBy(F.when(F.col("candidate_id") == default, 1).otherwise(0), "complexity", F.desc("score"), "candidate_id").limit(1).select("candidate_id", "score")


def importances(scorer: Scorer) -> dict[str, float]:
    """Share of reliance on each feature."""
    last = scorer.model.stages[-1]
    raw = np.abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else last.featureImportances.toArray()
    total = raw.sum()
    return dict(zip(scorer.features, (raw / total if total else raw).tolist(), strict=True))


def shuffled_within(df: DataFrame, columns: list[str], seed: int, name: str = "_other") -> DataFrame:
    """df with a struct of another row's columns: rows of a campaign are dealt to PARTS by a hash, and exchanged within those, so no task orders a whole campaign."""
    from pyspark.sql.window import Window

    part = F.pmod(F.xxhash64(F.lit(seed), "household_key"), F.lit(EXCHANGE_PARTS))
    x = df.withColumn("_part", part)
    inside = Window.partitionBy("campaign", "_part")
    a, b = F.row_number().over(inside.orderBy("household_key")), F.row_number().over(inside.orderBy(F.xxhash64("household_key", F.lit(seed + 1)), "household_key"))
    values = x.select("campaign", "_part", b.alias("_at"), F.struct(*columns).alias(name))
    return x.withColumn("_at", a).join(values, ["campaign", "_part", "_at"]).drop("_at", "_part")


def permutation_importance(scorer: Scorer, df: DataFrame, features: list[str], label: str, seed: int = 1) -> DataFrame:
    """(feature, capture, drop): capture in each campaign's top fifth when a feature has other households' values, and how much less that is than with its own."""
    from . import metrics

    x = shuffled_within(df, features, seed).withColumn("feature", F.explode(F.array(F.lit(""), *map(F.lit, features))))
    x = x.withColumns({c: F.when(F.col("feature") == c, F.col("_other").getField(c)).otherwise(F.col(c)) for c in features}).drop("_other")
    got = metrics.measured(scorer.score(x), ["score"], label, ["feature"], ["campaign"]).select("feature", "capture")
    own = got.where("feature = ''").select(F.col("capture").alias("_own"))
    return got.where("feature <> ''").crossJoin(F.broadcast(own)).select("feature", "capture", (F.col("_own") - F.col("capture")).alias("drop"))  # own: one row


def recency_weight(df: DataFrame, last_day: int, half_life: float) -> DataFrame:
    return df.withColumn("recency_weight", F.pow(F.lit(0.5), (F.lit(last_day) - F.col("start_day")) / F.lit(half_life)))


def rank_blend(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean of two scores' percent ranks within the campaign, ties at their average."""
    from pyspark.sql.window import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("campaign"))
    rank = lambda c: (F.rank().over(Window.partitionBy("campaign").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("campaign", c)) - 1) / 2) / n
    return df.withColumn("blend", (rank(a) + rank(b)) / 2)


def usual_spend() -> Column:
    """What a household usually spends on a campaign's products in as many days as the campaign lasts."""
    return F.col("campaign_product_spend_per_week_26w") * F.col("duration_days") / 7


def median_totals(df: DataFrame, x: str, y: str) -> tuple[float, float, float]:
    """median_line, and the factor that makes its total the actual one (1 where it predicts nothing)."""
    slope, intercept = median_line(df, x, y)
    predicted, actual = scored_line(df, x, slope, intercept, "_p").agg(F.sum("_p"), F.sum(y)).first()
    return slope, intercept, float(actual) / predicted if predicted else 1.0


def spend_if_redeem(rows: DataFrame, fitted_on: DataFrame, slope: float, intercept: float) -> DataFrame:
    """rows with spend_if_redeem, the line on usual_spend; null in campaigns that fitted_on lacks."""
    covered = fitted_on.select("campaign").distinct().withColumn("_covered", F.lit(True))
    x = scored_line(rows.withColumn("_x", usual_spend()), "_x", slope, intercept, "_p").join(F.broadcast(covered), "campaign", "left")  # campaigns: at most the checked table's
    return x.withColumn("spend_if_redeem", F.when(F.col("_covered"), F.col("_p"))).drop("_x", "_p", "_covered")


def splines(df: DataFrame, features: list[str], knots: int = 4) -> tuple[list[str], callable]:
    """Names of a cubic spline basis of each column, and a function that adds it: powers, and cubes beyond the knots inside the range of df."""
    ends = df.agg(*[f(signed_log(c)).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    made: dict[str, Column] = {}
    for c in features:
        low, span = ends[f"lo_{c}"] or 0.0, ((ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0)) or 1.0
        x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (signed_log(c) - low) / span))
        made |= {f"{c}_p{k}": F.pow(x, F.lit(k)) for k in (1, 2, 3)}
        made |= {f"{c}_k{i}": F.pow(F.greatest(x - i / (knots - 1), F.lit(0.0)), F.lit(3)) for i in range(1, knots - 1)}
    return list(made), lambda d: d.withColumns(made)


def spline_logistic(train: DataFrame, test: DataFrame, features: list[str], label: str, penalty: float = 0.001) -> DataFrame:
    """test with score: a logistic regression on a smooth curve for each column."""
    names, add = splines(train, features)
    return logistic(add(train), names, label, penalty).score(add(test)).drop(*names)


def by_type(train: DataFrame, test: DataFrame, make) -> DataFrame:
    """test with score: one model for type A campaigns, one for the others. make: (train) -> Scorer."""
    a = F.col("campaign_type") == "A"
    return make(train.where(a)).score(test.where(a)).unionByName(make(train.where(~a)).score(test.where(~a)))


def recent_only(folds: DataFrame, campaigns: DataFrame, n: int = 6) -> DataFrame:
    """(test_campaign, train_campaign) of each fold's n training campaigns that ended last."""
    from pyspark.sql.window import Window

    ended = folds.join(F.broadcast(campaigns.select(F.col("campaign").alias("train_campaign"), "end_day")), "train_campaign")  # pairs of campaigns
    place = F.row_number().over(Window.partitionBy("test_campaign").orderBy(F.desc("end_day"), F.desc("train_campaign")))
    return ended.withColumn("_place", place).where(F.col("_place") <= n).select("test_campaign", "train_campaign")


def type_interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each column's value in type A campaigns alone, 0 elsewhere: <column>_x_type_a."""
    return df.withColumns({f"{c}_x_type_a": F.when(F.col("campaign_type") == "A", F.col(c)).otherwise(F.lit(0)) for c in columns})


def single_feature_rank(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, direction, capture) of ranking each campaign of test by one column, in the direction of its rank correlation with the label in train."""
    from . import metrics

    rho = signal_rank_corr(train, features, label).select(F.col("column").alias("ranking"), F.when(F.coalesce("rho", F.lit(0.0)) >= 0, "higher").otherwise("lower").alias("direction"))
    both = test.withColumns({f"_less_{c}": -F.col(c).cast("double") for c in features})
    got = metrics.measured(both, [*features, *[f"_less_{c}" for c in features]], label, [], ["campaign"]).select("ranking", "capture")
    named = rho.withColumn("_key", F.when(F.col("direction") == "higher", F.col("ranking")).otherwise(F.concat(F.lit("_less_"), F.col("ranking"))))
    return named.join(got.withColumnRenamed("ranking", "_key"), "_key").select(F.col("ranking").alias("feature"), "direction", "capture")


def signal_rank_corr(df: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """(column, rho): Spearman's correlation of each column with an outcome, over rows where both are known."""
    from . import metrics

    stacked = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    x = df.select(F.col(outcome).cast("double").alias("y"), F.expr(f"stack({len(columns)}, {stacked}) AS (column, x)")).where("x is not null and y is not null")
    # one row a pair of values first, so that ranks are those of values
    return metrics.rank_correlation_of_counts(x.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n")), "x", "y", ["column"])


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], make, label: str) -> DataFrame:
    """(dropped, capture, change) of models without each group of features, and with all of them (dropped: none). make: (train, features) -> Scorer."""
    from . import metrics

    every, out = [c for g in groups.values() for c in g], None
    for name, gone in {"none": [], **groups}.items():
        rows = make(train, [c for c in every if c not in gone]).score(test)
        got = metrics.capture(rows, "score", label, by=["campaign"]).select(F.lit(name).alias("dropped"), "capture")
        out = got if out is None else out.unionByName(got)
    whole = out.where("dropped = 'none'").select(F.col("capture").alias("_all"))
    return out.crossJoin(F.broadcast(whole)).select("dropped", "capture", (F.col("capture") - F.col("_all")).alias("change"))  # a row a group
