"""Ranking, calibration and uplift metrics, each one or two passes of grouping and windows.

Windows are by campaign or over one row per distinct score and group, never over
all rows in one partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 128
VECTORS = 20_000
SHARES = tuple(round(0.05 * i, 2) for i in range(1, 11))


def _groups(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """One row a distinct score: rows n and positives pos, with those above it (n_above, pos_above) and all of its group (n_all, pos_all)."""
    g = df.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return ranked(g, by)


def ranked(g: DataFrame, by: list[str]) -> DataFrame:
    if not by:  # all scores together: they are cut into RANGES of about equal size first, whose sums are carried over
        cuts = g.agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
        g = g.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda e: e < F.col("s")))).drop("_cuts")
        sums = g.groupBy("_range").agg(F.sum("n").alias("rn"), F.sum("pos").alias("rp"))
        later = sums.selectExpr("_range AS _other", "rn AS on", "rp AS op")
        carried = sums.join(F.broadcast(later), F.col("_other") > F.col("_range"), "left").groupBy("_range").agg(F.coalesce(F.sum("on"), F.lit(0)).alias("cn"), F.coalesce(F.sum("op"), F.lit(0)).alias("cp"))
        total = sums.agg(F.sum("rn").alias("n_all"), F.sum("rp").alias("pos_all"))
        above = Window.partitionBy("_range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
        g = g.join(F.broadcast(carried), "_range").crossJoin(F.broadcast(total))
        return g.withColumn("n_above", F.coalesce(F.sum("n").over(above), F.lit(0)) + F.col("cn")).withColumn("pos_above", F.coalesce(F.sum("pos").over(above), F.lit(0)) + F.col("cp"))
    above = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    return g.select("*", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos_above"), F.sum("n").over(every).alias("n_all"), F.sum("pos").over(every).alias("pos_all"))


def ranked_by_ranges(g: DataFrame, by: list[str]) -> DataFrame:
    """ranked() for groups of any size: each group's values are cut into RANGES of about equal size, whose sums are carried over."""
    cuts = g.groupBy(*by).agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    g = g.join(cuts, by).withColumn("_range", F.size(F.filter("_cuts", lambda e: e < F.col("s")))).drop("_cuts")
    before, every = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    sums = g.groupBy(*by, "_range").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))  # at most RANGES rows a group
    carried = sums.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cn"), F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_cp"), F.sum("_n").over(every).alias("n_all"), F.sum("_p").over(every).alias("pos_all"))
    above = Window.partitionBy(*by, "_range").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    x = g.join(carried, [*by, "_range"])
    return x.withColumns({"n_above": F.coalesce(F.sum("n").over(above), F.lit(0)) + F.col("_cn"), "pos_above": F.coalesce(F.sum("pos").over(above), F.lit(0)) + F.col("_cp")})


def _depth(n: Column, share) -> Column:
    return F.greatest(F.lit(1.0), F.bround(n * share))


def _caught(k: Column) -> Column:
    """Positives of a score's rows in the top k, over all orders of its ties."""
    return F.col("pos") * F.greatest(F.lit(0.0), F.least(F.col("n").cast("double"), k - F.col("n_above"))) / F.col("n")


def capture(df: DataFrame, score: str, label: str, share: float = 0.2, by: list[str] | None = None) -> DataFrame:
    """Share of positives in the top share (of each group, with by), ties at the border counted by expectation: capture."""
    g = _groups(df, score, label, by or [])
    return g.agg((F.sum(_caught(_depth(F.col("n_all"), share))) / F.sum("pos")).alias("capture"))


def capture_curve(df: DataFrame, score: str, label: str, by: list[str], shares=SHARES) -> DataFrame:
    """(share, capture) at each depth, from one ranking."""
    g = _groups(df, score, label, by).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return g.groupBy("share").agg((F.sum(_caught(_depth(F.col("n_all"), F.col("share")))) / F.sum("pos")).alias("capture"))


def capture_average(df: DataFrame, score: str, label: str, by: list[str], shares=SHARES) -> DataFrame:
    return capture_curve(df, score, label, by, shares).agg(F.avg("capture").alias("capture"))


def random_capture(df: DataFrame, label: str, by: list[str], shares=(0.2,)) -> DataFrame:
    """(share, capture) of targeting at random."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return g.groupBy("share").agg((F.sum(F.col("pos") * _depth(F.col("n"), F.col("share")) / F.col("n")) / F.sum("pos")).alias("capture"))


def _auc_parts(g: DataFrame, by: list[str]) -> DataFrame:
    below = F.col("n_all") - F.col("n_above") - F.col("n") - (F.col("pos_all") - F.col("pos_above") - F.col("pos"))
    own_negatives = F.col("n") - F.col("pos")
    return g.groupBy(*by).agg(F.sum(F.col("pos") * (2 * below + own_negatives)).alias("wins2"), F.max("n_all").alias("n"), F.max("pos_all").alias("pos"))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """auc of each group (of all rows without by), ties counted half; null with one class."""
    parts = _auc_parts(_groups(df, score, label, by or []), by or [])
    pairs = 2 * F.col("pos") * (F.col("n") - F.col("pos"))
    return parts.select(*(by or []), "n", "pos", F.when(pairs > 0, F.col("wins2") / pairs).alias("auc"))


def within_auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """auc by group, averaged by rows over the groups with both classes."""
    a = auc(df, score, label, by).where("auc is not null")
    return a.agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    g = _groups(df, score, label, [])
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))
    return g.agg((F.sum(F.col("pos") * precision) / F.max("pos_all")).alias("average_precision"))


def capture_summary(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows, positives and capture in each campaign's top fifth, for all campaigns, type A, and the others."""
    group = F.explode(F.array(F.lit("all"), F.when(F.col("campaign_type") == "A", "A").otherwise("BC")))
    g = _groups(df.withColumn("group", group), score, label, ["group", "campaign"])
    return g.groupBy("group").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), (F.sum(_caught(_depth(F.col("n_all"), 0.2))) / F.sum("pos")).alias("capture"))


def edges(df: DataFrame, score: str, bins: int) -> DataFrame:
    """Equal-count bin edges of a score, as one row with an array."""
    return df.agg(F.percentile(score, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))


def binned(df: DataFrame, score: str, bins: int) -> DataFrame:
    """df with the bin (from 0) of its score; a score on an edge belongs below it."""
    place = F.size(F.filter("edges", lambda e: F.col(score) > e)).cast("long")
    return df.crossJoin(F.broadcast(edges(df, score, bins))).withColumn("bin", place).drop("edges")


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Rows, mean predicted and mean actual of each bin of the score."""
    return binned(df, score, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(label).cast("double")).alias("actual"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean squared error of the score and of the base rate."""
    y = F.col(label).cast("double")
    return df.agg(F.avg(F.pow(F.col(score) - y, 2)).alias("brier"), (F.avg(y) * (1 - F.avg(y))).alias("base_brier"))


def expected_by_campaign(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.groupBy("campaign").agg(F.sum(score).alias("expected"), F.sum(F.col(score) * (1 - F.col(score))).alias("chance_var"), F.sum(F.col(label).cast("double")).alias("actual"))


def errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """mae, median_ae and total_ratio of a money prediction."""
    gap = F.abs(F.col(predicted) - F.col(actual))
    return df.agg(F.avg(gap).alias("mae"), F.median(gap).alias("median_ae"), (F.sum(predicted) / F.sum(actual)).alias("total_ratio"))


def average_rank(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, value, n, mean rank) of each distinct value."""
    g = df.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return g.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)


def rank_correlation(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Spearman's correlation of two columns in each group."""
    ra = average_rank(df, a, by).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("value").alias("_a"), F.col("rank").alias("rank_a"))
    rb = average_rank(df, b, by).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("value").alias("_b"), F.col("rank").alias("rank_b"))
    same = lambda mark, value, other: [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in by] + [F.col(value).eqNullSafe(F.col(other))]
    joined = df.join(ra, same("_", a, "_a")).join(rb, same("__", b, "_b"))
    return joined.groupBy(*by).agg(F.corr("rank_a", "rank_b").alias("rho"))


def rank_correlation_of_counts(g: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Spearman's correlation in each group, from rows of two values and how often they stand together (n)."""

    def ranks(c: str) -> DataFrame:
        sums = g.groupBy(*by, c).agg(F.sum("n").alias("_m"))
        before = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*by, c, (F.coalesce(F.sum("_m").over(before), F.lit(0)) + (F.col("_m") + 1) / 2).alias(f"_r_{c}"))

    x = g.join(ranks(a), [*by, a]).join(ranks(b), [*by, b])
    r, s, n = F.col(f"_r_{a}"), F.col(f"_r_{b}"), F.sum("n")
    mean = lambda c: F.sum(F.col("n") * c) / n
    cov, va, vb = mean(r * s) - mean(r) * mean(s), mean(r * r) - mean(r) * mean(r), mean(s * s) - mean(s) * mean(s)
    return x.groupBy(*by).agg(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("rho"))


# Uplift


def _arms(df: DataFrame, score: str, label: str, treatment: str, by: list[str], weight: str | None = None) -> DataFrame:
    """One row a distinct score: rows n, gain (treated positives less control positives scaled by treated / control of the whole group), those before it, and of the group n_all, treated and control.

    Sums are of the weight, rows count as rows. A group without one of the arms has no gain anywhere.
    """
    t, y, w = F.col(treatment).cast("double"), F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    g = df.groupBy(*by, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(w * t).alias("wt"), F.sum(w * (1 - t)).alias("wc"), F.sum(w * t * y).alias("yt"), F.sum(w * (1 - t) * y).alias("yc"))
    every, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)
    both = g.select(*by, "s", "n", "yt", "yc", F.sum("n").over(every).alias("n_all"), F.sum("wt").over(every).alias("treated"), F.sum("wc").over(every).alias("control"))
    gain = F.when((F.col("treated") > 0) & (F.col("control") > 0), F.col("yt") - F.col("yc") * F.col("treated") / F.col("control")).otherwise(0.0)
    both = both.withColumn("gain", gain)
    return both.withColumns({"n_above": F.coalesce(F.sum("n").over(before), F.lit(0)), "gain_above": F.coalesce(F.sum("gain").over(before), F.lit(0.0))})


def qini(df: DataFrame, score: str, label: str, treatment: str, by: list[str]) -> DataFrame:
    """Area between each group's Qini curve, over shares of rows from the first row on, and the straight line to its end: qini and treated.

    Tied rows stand in all orders, so the curve is straight through them; areas are sums over the ties.
    """
    g = _arms(df, score, label, treatment, by)
    n, curve = F.col("n_all"), F.sum(F.col("n") * F.col("gain_above") + F.col("gain") * (F.col("n") + 1) / 2)
    first = F.max_by(F.col("gain") / F.col("n"), F.col("s"))
    sums = g.groupBy(*by, "n_all", "treated").agg(curve.alias("curve"), F.sum("gain").alias("end"), first.alias("first"))
    area = (F.col("curve") - F.col("end") * (n + 1) / 2 - (F.col("first") - F.col("end") / n) / 2) / n
    return sums.select(*by, area.alias("qini"), F.col("treated").cast("long").alias("treated"))


def stratified_qini(df: DataFrame, score: str, label: str, treatment: str, by: str = "campaign", weighted: bool = False, grid: int = 100) -> DataFrame:
    """Each group's gains at grid + 1 even depths, added over groups; the area over the straight line, for each treated row.

    weighted: rows in_overlap only, with ipw_weight. Groups without one of the arms are left out.
    """
    data = df.where("in_overlap") if weighted else df
    g = _arms(data, score, label, treatment, [by], "ipw_weight" if weighted else None).where("treated > 0 and control > 0")
    # depth i is the row number ceil(i / grid * n_all); it lies in these rows if it is over n_above and at most n_above + n
    depth = lambda rows: F.expr(f"{grid} * ({rows}) div n_all")
    inside = F.when(depth("n_above + n") > depth("n_above"), F.sequence(depth("n_above") + 1, depth("n_above + n")))
    at = g.select("gain_above", "gain", "n", "n_above", "n_all", F.explode(inside).alias("i"))
    row = F.ceil(F.col("i") * F.col("n_all") / grid)
    curve = at.groupBy("i").agg(F.sum(F.col("gain_above") + F.col("gain") * (row - F.col("n_above")) / F.col("n")).alias("gain"))
    # the area over the line to the end, at even steps with nothing at both ends, is the mean of what is between
    area = curve.agg(((F.sum(F.when(F.col("i") < grid, F.col("gain"))) - F.max(F.when(F.col("i") == grid, F.col("gain"))) * (grid - 1) / 2) / grid).alias("area"))
    treated = g.groupBy(by).agg(F.first("treated").alias("treated")).agg(F.sum("treated").alias("treated"))
    return area.crossJoin(treated).select((F.col("area") / F.col("treated")).alias("qini"))  # one row each


def uplift_in(df: DataFrame, by: list[str], label: str, treatment: str) -> DataFrame:
    """Rows, treated and control rates, and their difference."""
    t, y = F.col(treatment) == 1, F.col(label).cast("double")
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(t).alias("n_treated"), F.avg(F.when(t, y)).alias("treated_rate"), F.avg(F.when(~t, y)).alias("control_rate"))
    return g.withColumn("uplift", F.col("treated_rate") - F.col("control_rate"))


def uplift_extremes(df: DataFrame, score: str, label: str, treatment: str) -> DataFrame:
    """uplift_in the lowest and highest fifth of the score."""
    return uplift_in(binned(df, score, 5).where("bin in (0, 4)"), ["bin"], label, treatment)


def balance(df: DataFrame, covariates: list[str], weight: str, treatment: str, least_treated: int = 20) -> DataFrame:
    """(covariate, smd): the size of the weighted difference of means in pooled standard deviations (0 where nothing varies), averaged over campaigns with enough treated rows and any control."""
    stacked = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in covariates)
    x = df.selectExpr("campaign", f"{treatment} AS t", f"{weight} AS w", f"stack({len(covariates)}, {stacked}) AS (covariate, x)")
    t = F.col("t") == 1
    mean = lambda c: F.sum(F.when(c, F.col("w") * F.col("x"))) / F.sum(F.when(c, F.col("w")))
    g = x.groupBy("campaign", "covariate").agg(F.count_if(t).alias("n"), F.count_if(~t).alias("n0"), mean(t).alias("m1"), mean(~t).alias("m0"), F.var_samp(F.when(t, F.col("x"))).alias("v1"), F.var_samp(F.when(~t, F.col("x"))).alias("v0"))
    sd = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    gap = F.when(sd > 0, F.abs(F.col("m1") - F.col("m0")) / sd).otherwise(0.0)
    return g.where((F.col("n") >= least_treated) & (F.col("n0") > 0)).groupBy("covariate").agg(F.avg(gap).alias("smd"))


def ipw(df: DataFrame, propensity: str, treatment: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """df with ipw_weight (1 / p of treated rows, 1 / (1 - p) of others) and in_overlap."""
    p = F.col(propensity)
    return df.withColumn("ipw_weight", F.when(F.col(treatment) == 1, 1 / p).otherwise(1 / (1 - p))).withColumn("in_overlap", p.between(low, high))


def e_value(treated_rate: Column, control_rate: Column) -> Column:
    """How strongly something unmeasured would have to go with both treatment and outcome to explain the ratio; null without a ratio or a difference."""
    r = F.greatest(treated_rate / control_rate, control_rate / treated_rate)
    same = F.abs(treated_rate - control_rate) <= 1e-8 + 1e-5 * F.abs(control_rate)
    return F.when((treated_rate > 0) & (control_rate > 0) & ~same, r + F.sqrt(r * (r - 1)))


def att_check(df: DataFrame, score: str, label: str, treatment: str, propensity: str = "propensity") -> DataFrame:
    """Mean predicted uplift of treated overlap rows beside the difference of rates, controls weighted by the odds of treatment, and the E-value of their ratio."""
    t, y, w = F.col(treatment) == 1, F.col(label).cast("double"), F.col(propensity) / (1 - F.col(propensity))
    g = df.where("in_overlap").agg(F.avg(F.when(t, F.col(score))).alias("predicted"), F.avg(F.when(t, y)).alias("treated_rate"), (F.sum(F.when(~t, w * y)) / F.sum(F.when(~t, w))).alias("control_rate"))
    return g.withColumn("att", F.col("treated_rate") - F.col("control_rate")).withColumn("e_value", e_value(F.col("treated_rate"), F.col("control_rate")))


def forecast_range(per_campaign: DataFrame, z: float = 1.96, gap: int = 7) -> DataFrame:
    """Range of each campaign's actual count: chance, widened by the misses of campaigns that ended a week before its start."""
    past = per_campaign.selectExpr("campaign AS other", "end_day AS other_end", "(actual - expected) * (actual - expected) / chance_var AS miss")
    joined = per_campaign.join(F.broadcast(past), F.col("other_end") < F.col("start_day") - gap, "left")
    phi = joined.groupBy("campaign", "expected", "chance_var", "actual").agg(F.greatest(F.lit(1.0), F.coalesce(F.avg("miss"), F.lit(1.0))).alias("phi"))
    half = z * F.sqrt(F.col("chance_var") * F.col("phi"))
    out = phi.withColumn("low", F.col("expected") - half).withColumn("high", F.col("expected") + half)
    return out.withColumn("covered", F.col("actual").between(F.col("low"), F.col("high")))


def newest_group(per_group: DataFrame, value: str, order: str, k: float = 2.0) -> DataFrame:
    """The newest group's value against mean and k standard deviations of all earlier ones."""
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = per_group.withColumn("mean", F.avg(value).over(earlier)).withColumn("sd", F.stddev_samp(value).over(earlier)).withColumn("_place", F.row_number().over(Window.orderBy(F.desc(order))))
    return x.where("_place = 1").drop("_place").withColumn("usual", F.abs(F.col(value) - F.col("mean")) <= k * F.col("sd"))


def wide(predictions: DataFrame, keys: list[str], candidates: list[str]) -> DataFrame:
    """One score column for each candidate."""
    return predictions.groupBy(*keys).pivot("candidate_id", candidates).agg(F.first("score"))


def contract(predictions: DataFrame) -> DataFrame:
    """(check, n_bad): repeated predictions, blank scores, rows without exactly one chosen candidate."""
    key = ["household_key", "campaign"]
    row = predictions.agg(F.count_if(F.col("score").isNull()).alias("blank"))
    repeated = predictions.groupBy(*key, "candidate_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    chosen = predictions.groupBy(*key).agg(F.count_if(F.col("chosen")).alias("c")).agg(F.count_if(F.col("c") != 1).alias("not_one_choice"))
    return row.crossJoin(repeated).crossJoin(chosen).selectExpr("stack(3, 'blank', blank, 'repeated', repeated, 'not_one_choice', not_one_choice) AS (`check`, n_bad)")


# Resampling and comparisons of two scores


# Cumulative Poisson(1) probabilities.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def resampled(df: DataFrame, cluster: list[str], reps: int, seed: int) -> DataFrame:
    """df repeated for `reps` draws of whole clusters with replacement: column rep, and multiplicity, Poisson(1) drawn from a digest of (seed, rep, cluster), so that it needs no shuffle.

    For tables of few rows; draw_counts() is for many.
    """
    key = [F.col(c).cast("string") for c in cluster]

    def drawn(rep: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), *key))
        return F.struct(rep.alias("rep"), (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / (1 << 32)).alias("_u"))

    # the draws are values of an array: a condition on a column would be moved before it and make the digest anew for each of its terms
    x = df.withColumn("_draw", F.explode(F.transform(F.sequence(F.lit(1), F.lit(reps)), drawn))).select(*df.columns, "_draw.*")
    times = sum((F.when(F.col("_u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    return x.where(F.col("_u") >= POISSON[0]).withColumn("multiplicity", times).drop("_u")


def draw_counts(df: DataFrame, scores: list[str], label: str, within: list[str], cluster: list[str], reps: int, seed: int) -> DataFrame:
    """(rep, ranking, within, s, n, pos): rows and positives of each distinct score in each draw of resampled().

    A row is not repeated for its draws. A task adds up vectors with a number for each draw, for up to VECTORS scores at
    a time, and sends those; draws in which a score has no row are left out.
    """
    columns = [f"_s{i}" for i in range(len(scores))]
    key = F.concat_ws("|", F.lit(""), *[F.col(c).cast("string") for c in cluster]).cast("binary")
    rows = df.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], key.alias("_key"), F.col(label).cast("long").alias("_y"), *[F.col(c).cast("double").alias(n) for c, n in zip(scores, columns, strict=True)])
    groups, heads = [f"_w{i}" for i in range(len(within))], [f"{seed}|{r}".encode() for r in range(1, reps + 1)]
    kinds = {f"_w{i}": df.schema[c].dataType.simpleString() for i, c in enumerate(within)}

    def run(batches):
        place, values = {}, [[], []]

        def sent():
            named = list(zip(*place, strict=True))
            made = [pa.array(named[0], pa.int32()), *[pa.array(v, batch.schema.field(g).type) for g, v in zip(groups, named[3:], strict=True)], pa.array(named[1], pa.float64())]
            lists = [pa.array([v if known else None for v, known in zip(x, named[2] if i else [True] * len(x), strict=True)], pa.list_(pa.int64())) for i, x in enumerate(values)]
            return pa.RecordBatch.from_arrays([*made, *lists], names=["at", *groups, "s", "n", "pos"])

        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column("_key").dictionary_encode()
            tails = keys.dictionary.to_pylist()
            digests = b"".join([hashlib.md5(h + t, usedforsecurity=False).digest()[:4] for t in tails for h in heads])
            u = np.frombuffer(digests, ">u4").reshape(len(tails), reps) / float(1 << 32)
            times = np.searchsorted(POISSON, u, side="right")[keys.indices.to_numpy()]
            y = batch.column("_y")
            hits = times * y.fill_null(0).to_numpy()[:, None]
            for i, c in enumerate(columns):
                coded = [x.dictionary_encode("encode") for x in (batch.column(c), y.is_valid(), *[batch.column(g) for g in groups])]
                code = np.zeros(len(batch), np.int64)
                for x in coded:
                    code = code * len(x.dictionary) + x.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
                first = pa.array(order[starts])
                names = zip(*[x.dictionary.take(x.indices.take(first)).to_pylist() for x in coded], strict=True)
                for name, n, pos in zip(names, np.add.reduceat(times[order], starts), np.add.reduceat(hits[order], starts), strict=True):
                    at = place.setdefault((i, *name), len(place))
                    if at == len(values[0]):
                        values[0].append(n)
                        values[1].append(pos)
                    else:
                        values[0][at] = values[0][at] + n
                        values[1][at] = values[1][at] + pos
            if len(place) >= VECTORS:
                yield sent()
                place, values = {}, [[], []]
        if place:
            yield sent()

    made = rows.mapInArrow(run, ", ".join(["at int", *[f"{g} {k}" for g, k in kinds.items()], "s double", "n array<bigint>", "pos array<bigint>"]))
    ranking = F.element_at(F.array(*map(F.lit, scores)), F.col("at") + 1).alias("ranking")
    each = made.select(ranking, *[F.col(g).alias(c) for g, c in zip(groups, within, strict=True)], "s", "pos", F.posexplode("n").alias("_rep", "_n")).where("_n > 0")
    each = each.select((F.col("_rep") + 1).alias("rep"), "ranking", *within, "s", "_n", F.get("pos", F.col("_rep")).alias("_pos"))
    return each.groupBy("rep", "ranking", *within, "s").agg(F.sum("_n").alias("n"), F.sum("_pos").alias("pos"))


MEASURES = ("capture", "capture_avg", "auc")


def measured(df: DataFrame, scores: list[str], label: str, by: list[str], within: list[str], weight: str | None = None, share: float = 0.2) -> DataFrame:
    """(by, ranking, MEASURES) of each score: positives caught in the top share, and on average over SHARES, of each group of `within`, and AUC within it, averaged by rows. weight: how often a row counts."""
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    stacked = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in scores)
    x = df.select(*by, *within, w.alias("_w"), F.col(label).cast("long").alias("_y"), F.expr(f"stack({len(scores)}, {stacked}) AS (ranking, s)"))
    counts = x.groupBy(*by, "ranking", *within, "s").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y")).alias("pos"))
    return measured_counts(counts, by, within, share)


def measured_counts(counts: DataFrame, by: list[str], within: list[str], share: float = 0.2) -> DataFrame:
    """measured() of one row for each distinct score: by, ranking, within, s, rows n and positives pos."""
    keys = [*by, "ranking", *within]
    g = ranked(counts, keys)
    below = F.col("n_all") - F.col("n_above") - F.col("n") - (F.col("pos_all") - F.col("pos_above") - F.col("pos"))
    caught = [F.sum(_caught(_depth(F.col("n_all"), a))).alias(f"_c{i}") for i, a in enumerate((share, *SHARES))]
    each = g.groupBy(*keys).agg(*caught, F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum(F.col("pos") * (2 * below + F.col("n") - F.col("pos"))).alias("wins2"))
    known = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    auc_ = F.when(known, F.col("wins2") / (2 * F.col("pos") * (F.col("n") - F.col("pos"))))
    mean_capture = sum((F.sum(f"_c{i + 1}") for i in range(len(SHARES))), F.lit(0.0)) / (len(SHARES) * F.sum("pos"))
    return each.groupBy(*by, "ranking").agg((F.sum("_c0") / F.sum("pos")).alias("capture"), mean_capture.alias("capture_avg"), (F.sum(auc_ * F.col("n")) / F.sum(F.when(known, F.col("n")))).alias("auc"))


def gaps(df: DataFrame, a: str, b: str, label: str, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, MEASURES) of score a less those of score b, within campaigns."""
    return _gaps(measured(df, [a, b], label, by, ["campaign"], weight), a, by)


def _gaps(found: DataFrame, a: str, by: list[str]) -> DataFrame:
    sign = F.when(F.col("ranking") == a, 1).otherwise(-1)
    return found.groupBy(*by).agg(*[F.sum(sign * F.col(c)).alias(c) for c in MEASURES])


def drawn_gaps(df: DataFrame, a: str, b: str, label: str, reps: int, seed: int) -> DataFrame:
    """gaps() of each draw of whole households."""
    counts = draw_counts(df, [a, b], label, ["campaign"], ["household_key"], reps, seed)
    return _gaps(measured_counts(counts, ["rep"], ["campaign"]), a, ["rep"])


def measure_gaps(df: DataFrame, a: str, b: str, label: str, reps: int = 300, seed: int = 3) -> DataFrame:
    """(measure, gap, spread, gap_over_spread, low, high): score a less score b, and the spread and 95% range of that over draws of whole households."""
    point = gaps(df, a, b, label, [])
    draws = drawn_gaps(df, a, b, label, reps, seed)
    spread = draws.agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in MEASURES for n, f in (("sd", F.stddev_pop), ("low", lambda x: F.percentile(x, 0.025)), ("high", lambda x: F.percentile(x, 0.975)))])  # a row a draw
    rows = ", ".join(f"'{c}', {c}, {c}_sd, {c} / {c}_sd, {c}_low, {c}_high" for c in MEASURES)
    return point.crossJoin(spread).selectExpr(f"stack({len(MEASURES)}, {rows}) AS (measure, gap, spread, gap_over_spread, low, high)")


def paired_gap(df: DataFrame, a: str, b: str, label: str, reps: int = 200, seed: int = 7) -> DataFrame:
    """One row: gaps of score a over score b in AUC and capture with 95% ranges, campaigns with a better AUC by a, and the AUC gap of the earlier and the later half of the campaigns (by start_day)."""
    low_high = [F.percentile(c, q).alias(f"{c}_{n}") for c in ("auc", "capture") for q, n in ((0.025, "low"), (0.975, "high"))]
    draws = drawn_gaps(df, a, b, label, reps, seed).agg(*low_high)
    point = gaps(df, a, b, label, []).select(F.col("auc").alias("auc_gap"), F.col("capture").alias("capture_gap"))
    better = auc(df, a, label, ["campaign"]).select("campaign", F.col("auc").alias("_a")).join(auc(df, b, label, ["campaign"]).select("campaign", F.col("auc").alias("_b")), "campaign")
    counts = better.agg(F.count_if(F.col("_a") > F.col("_b")).alias("campaigns_better"), F.count("_a").alias("campaigns"))
    order = df.groupBy("campaign").agg(F.min("start_day").alias("_start")).withColumn("_place", F.row_number().over(Window.orderBy("_start", "campaign")))  # a row a campaign
    half = order.crossJoin(order.agg(F.count(F.lit(1)).alias("_n"))).select("campaign", F.when(F.col("_place") <= F.floor(F.col("_n") / 2) + 1, "early").otherwise("late").alias("half"))
    halves = gaps(df.join(F.broadcast(half), "campaign"), a, b, label, ["half"]).agg(*[F.max(F.when(F.col("half") == h, F.col("auc"))).alias(f"auc_gap_{h}") for h in ("early", "late")])
    return point.crossJoin(draws).crossJoin(counts).crossJoin(halves)  # one row each


def bootstrap_capture(df: DataFrame, a: str, b: str, label: str, cluster: list[str], reps: int = 300, seed: int = 1) -> DataFrame:
    """Capture in each campaign's top fifth by two scores over draws of clusters: 95% intervals of both and of the gap, and the verdict on the gap. cluster: household_key for whole households; household_key and campaign for rows within campaigns."""
    draws = measured_counts(draw_counts(df, [a, b], label, ["campaign"], cluster, reps, seed), ["rep"], ["campaign"])
    pick = lambda c: F.max(F.when(F.col("ranking") == c, F.col("capture")))
    both = draws.groupBy("rep").agg(pick(a).alias(f"capture_{a}"), pick(b).alias(f"capture_{b}")).withColumn("gap", F.col(f"capture_{a}") - F.col(f"capture_{b}"))
    out = both.agg(*[F.percentile(c, q).alias(f"{c}_{n}") for c in (f"capture_{a}", f"capture_{b}", "gap") for q, n in ((0.025, "low"), (0.975, "high"))], F.stddev_pop("gap").alias("gap_sd"))
    return out.withColumn("verdict", F.when(F.col("gap_low") > 0, "pass").when(F.col("gap_high") < 0, "fail").otherwise("inconclusive"))


def campaign_bootstrap(df: DataFrame, predicted: str, benchmark: str, actual: str, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Mean absolute error of a prediction less that of a benchmark, its 95% range over draws of whole campaigns, and the share of draws in which it is below zero."""
    miss = lambda c: F.sum(F.abs(F.col(c) - F.col(actual)))
    per = df.groupBy("campaign").agg((miss(predicted) - miss(benchmark)).alias("more"), F.count(F.lit(1)).alias("n"))
    mean = F.sum(F.col("multiplicity") * F.col("more")) / F.sum(F.col("multiplicity") * F.col("n"))
    draws = resampled(per, ["campaign"], reps, seed).groupBy("rep").agg(mean.alias("d")).agg(F.percentile("d", 0.025).alias("ci_low"), F.percentile("d", 0.975).alias("ci_high"), F.avg((F.col("d") < 0).cast("double")).alias("share_better"))
    return per.agg((F.sum("more") / F.sum("n")).alias("diff")).crossJoin(draws)  # one row each
