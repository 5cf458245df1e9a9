"""Which columns a logistic regression needs: fits on many sets of columns, judged out of time, in shared scans."""

from __future__ import annotations

from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import metrics
from .many_fits import Fit, Line, fit_logistics, score_logistics

MEASURES = metrics.MEASURES


def fitted_sets(table: DataFrame, train: tuple, sets: dict[str, list[str]], label: str, penalty: float = 0.01) -> dict[str, Line]:
    return fit_logistics(table, {k: Fit(train, tuple(c), penalty) for k, c in sets.items() if c}, label)


def judged_sets(table: DataFrame, folds: list[tuple], sets: dict[str, list[str]], label: str, penalty: float = 0.01) -> DataFrame:
    """(set, MEASURES) of each set of columns over all folds (test campaign, training campaigns) together. Training campaigns that folds share are fitted once."""
    trains: dict[tuple, list] = {}
    for test, train in folds:
        trains.setdefault(tuple(sorted(train)), []).append(test)
    fits = {(train, k): Fit(train, tuple(c), penalty) for train in trains for k, c in sets.items()}
    lines = fit_logistics(table, fits, label)
    scored = score_logistics(table, lines, {(train, k): {k: trains[train]} for train, k in lines}, ["household_key", label], "set")
    return metrics.measured(scored, ["score"], label, ["set"], ["campaign"]).drop("ranking")


def ablation(table: DataFrame, folds: list[tuple], groups: dict[str, list[str]], label: str, penalty: float = 0.01) -> DataFrame:
    """(dropped, capture, change) of models without each group of columns, and with all of them (dropped: none)."""
    sets = {"none": [c for g in groups.values() for c in g], **{k: [c for o, g in groups.items() if o != k for c in g] for k in groups}}
    got = judged_sets(table, folds, sets, label, penalty)
    whole = got.where("set = 'none'").select(F.col("capture").alias("_all"))
    return got.crossJoin(F.broadcast(whole)).select(F.col("set").alias("dropped"), "capture", (F.col("capture") - F.col("_all")).alias("change"))  # whole: one row


def add_one_curve(table: DataFrame, folds: list[tuple], groups: dict[str, list[str]], label: str, penalty: float = 0.01, measure: str = "capture_avg", most: int | None = None) -> list[dict]:
    """Greedy search: each round adds the group that gains most (the earlier name on a tie). One record a round: step, added, measure, gain, and the scores of all that were tried.

    A round is one judged_sets over the groups that are left.
    """
    chosen: list[str] = []
    out, last = [], None
    while len(chosen) < len(groups) and (most is None or len(chosen) < most):
        sets = {k: [c for g in [*chosen, k] for c in groups[g]] for k in groups if k not in chosen}
        scores = {r["set"]: r[measure] for r in judged_sets(table, folds, sets, label, penalty).collect() if r[measure] is not None}  # a row a group
        if not scores:
            break
        best = min(scores, key=lambda k: (-scores[k], k))
        out.append({"step": len(out) + 1, "added": best, "measure": scores[best], "gain": scores[best] - last if last is not None else None, "tried": scores})
        chosen.append(best)
        last = scores[best]
    return out


def by_group(table: DataFrame, train: dict, test: dict, columns: list[str], label: str, penalty: float = 0.01) -> DataFrame:
    """household_key, campaign, label and score: one model for each group of campaigns. train, test: group -> campaigns."""
    lines = fit_logistics(table, {g: Fit(tuple(c), tuple(columns), penalty) for g, c in train.items()}, label)
    return score_logistics(table, lines, {g: {str(g): test.get(g, ())} for g in lines}, ["household_key", label]).drop("fit").withColumnRenamed(label, "label")


#: Parts of a campaign that exchange values among themselves, how many of them a task takes, and buckets of a score.
EXCHANGED, TOGETHER, BUCKETS = 64, 8, 1024


def _bucket(score: np.ndarray) -> np.ndarray:
    """A number that never falls as the score rises; its steps are finer where scores are low."""
    return np.minimum(BUCKETS - 1, np.sqrt(np.sqrt(score)) * BUCKETS).astype(np.int64)


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterable[pa.RecordBatch]:
    """Rows of one key after the other, of batches that are ordered by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        codes = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        cuts = [0, *[i for i in range(1, len(codes)) if codes[i] != codes[i - 1]], len(codes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and codes[a] != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = codes[a]
    if held:
        yield pa.concat_batches(held)


def _exchanged_scores(x: np.ndarray, line: Line, draws: int, seed: tuple) -> Iterable[tuple[int, np.ndarray]]:
    """(place, scores): 0 for the rows as they are; 1 + draw * columns + column where that column has the values of other rows of x.

    A score depends on its row's values alone, not on which of them are its own, so equal rows tie.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    terms = x * line.coefficients
    before = np.column_stack((np.full(len(x), line.intercept), terms)).cumsum(axis=1)
    after = np.column_stack((terms[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros(len(x))))
    yield 0, sigmoid(before[:, -1])
    for d in range(draws):
        other = terms[np.random.default_rng(crc32(repr((*seed, d)).encode())).permutation(len(x))]
        for i in range(x.shape[1]):
            yield 1 + d * x.shape[1] + i, sigmoid(before[:, i] + other[:, i] + after[:, i + 1])


def permutation_importance(table: DataFrame, folds: list[tuple], columns: list[str], label: str, draws: int = 5, penalty: float = 0.01, seed: int = 1) -> DataFrame:
    """(feature, drop, spread): how much less is caught in each campaign's top fifth when a column has other households' values, its mean and spread over draws, over all folds together.

    Rows are dealt by campaign and a hash of the household, once for all columns and draws, and exchange values with those
    dealt with them. Scores are never rows of a table: a first pass counts them by bucket, which tells the bucket where
    a campaign's top fifth ends, and a second one ranks those of that bucket.
    """
    trains: dict[tuple, list] = {}
    for test, train in folds:
        trains.setdefault(tuple(sorted(train)), []).append(test)
    lines = fit_logistics(table, {t: Fit(t, tuple(columns), penalty) for t in trains}, label)
    of: dict = {}
    for t, line in lines.items():
        for c in trains[t]:
            of.setdefault(c, []).append(line)
    kind, campaign_type, places = table.schema["campaign"].dataType.simpleString(), to_arrow_type(table.schema["campaign"].dataType), 1 + draws * len(columns)
    part = F.pmod(F.xxhash64(F.lit(seed), "household_key"), F.lit(EXCHANGED))
    rows = table.where(F.col("campaign").isin(list(of))).select("campaign", part.alias("part"), "household_key", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("y"))
    dealt = rows.withColumn("task", F.col("part") % TOGETHER).repartition("campaign", "task").sortWithinPartitions("campaign", "part", "household_key").drop("task", "household_key")

    def scored(batches):
        for group in _groups(batches, ["campaign", "part"]):
            c = group.column("campaign")[0].as_py()
            x = group.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(group), len(columns))
            y = group.column("y").to_numpy(zero_copy_only=False)
            for i, line in enumerate(of[c]):
                for place, scores in _exchanged_scores(x, line, draws, (seed, c, group.column("part")[0].as_py(), i)):
                    yield c, y, place, scores

    def counted(batches):
        def sent():
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([campaign] * len(at)).cast(campaign_type), pa.array(at // BUCKETS, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(n[at], pa.int64()), pa.array(np.rint(pos[at]), pa.int64(), safe=False)], names=["campaign", "place", "bucket", "n", "pos"])

        campaign, n, pos = None, None, None
        for c, y, place, scores in scored(batches):
            if n is None or c != campaign:
                if n is not None:
                    yield sent()
                campaign, n, pos = c, np.zeros(places * BUCKETS, np.int64), np.zeros(places * BUCKETS)
            bucket, at = _bucket(scores), slice(place * BUCKETS, (place + 1) * BUCKETS)
            n[at] += np.bincount(bucket, minlength=BUCKETS)
            pos[at] += np.bincount(bucket, y, minlength=BUCKETS)
        if n is not None:
            yield sent()

    counts = dealt.mapInArrow(counted, f"campaign {kind}, place int, bucket int, n long, pos long").groupBy("campaign", "place", "bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    ends = metrics.ranked(counts.withColumnRenamed("bucket", "s"), ["campaign", "place"]).withColumn("depth", metrics._depth(F.col("n_all"), 0.2)).where("n_above < depth and depth <= n_above + n").collect()  # a row a campaign, column and draw
    border = {(r["campaign"], r["place"]): r["s"] for r in ends}

    def inside(batches):
        for c, y, place, scores in scored(batches):
            at = np.flatnonzero(_bucket(scores) == border[c, place])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(at)).cast(campaign_type), pa.array([place] * len(at), pa.int32()), pa.array(scores[at]), pa.array(y[at])], names=["campaign", "place", "s", "y"])

    spark = table.sparkSession
    above = spark.createDataFrame([(r["campaign"], r["place"], r["n_above"], r["pos_above"], r["pos_all"], r["depth"]) for r in ends], f"campaign {kind}, place int, n_over long, pos_over long, pos_campaign long, depth double")
    near = dealt.mapInArrow(inside, f"campaign {kind}, place int, s double, y double").groupBy("campaign", "place", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos"))
    caught = metrics.ranked(near, ["campaign", "place"]).join(F.broadcast(above), ["campaign", "place"]).groupBy("campaign", "place").agg((F.max("pos_over") + F.sum(metrics._caught(F.col("depth") - F.col("n_over")))).alias("caught"), F.max("pos_campaign").alias("pos"))
    got = caught.groupBy("place").agg((F.sum("caught") / F.sum("pos")).alias("capture"))
    names = spark.createDataFrame([(1 + d * len(columns) + i, c) for d in range(draws) for i, c in enumerate(columns)], "place int, feature string")  # a row a column and draw
    own = got.where("place = 0").select(F.col("capture").alias("_own"))
    return got.join(F.broadcast(names), "place").crossJoin(F.broadcast(own)).groupBy("feature").agg(F.avg(F.col("_own") - F.col("capture")).alias("drop"), F.stddev_pop("capture").alias("spread"))  # own: one row


def spline_columns(df: DataFrame, columns: list[str], knots: int = 4) -> tuple[DataFrame, list[str]]:
    """df with a cubic spline basis of each column between its least and greatest value, and its columns' names."""
    from .models import splines

    names, add = splines(df, columns, knots)
    return add(df), names


def signed_logs(columns: list[str]) -> dict[str, Column]:
    from .models import signed_log

    return {c: signed_log(c) for c in columns}
