"""Many logistic regressions over subsets of one table's campaigns and columns, in scans that they share.

A fit is a set of campaigns and a list of columns. Each Newton step of all fits
is one pass: a task adds up gradient and Hessian of every fit over its rows (fits
on the same columns together, as products of matrices that each campaign's rows
are turned into once), and sends one row for each fit, whatever its number of rows; the driver gets columns
squared numbers a fit and solves. So the number of scans is the number of steps
of the slowest fit (ten or so), not folds x candidates, and predictions of all
fits are one more scan. The objective is that of Spark ML's LogisticRegression
on standardised columns: mean log loss plus penalty / 2 times the squared
coefficients.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    campaigns: tuple
    columns: tuple[str, ...]
    penalty: float = 0.001


@dataclass
class Line:
    """A fitted logistic regression, in the units of its columns."""

    columns: tuple[str, ...]
    coefficients: np.ndarray
    intercept: float


def _inputs(df: DataFrame, columns: list[str], label: str | None, weight: str | None, keys: Iterable[str] = ()) -> DataFrame:
    one = F.lit(1.0)
    return df.select(*keys, F.col("campaign").alias("_campaign"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"), (F.col(label).cast("double") if label else one).alias("_y"), (F.col(weight).cast("double") if weight else one).alias("_w"))


#: Rows that a task turns into matrices at once.
CHUNK = 65_536


def _matrix(batch: pa.RecordBatch, width: int) -> tuple:
    """Place of each row's campaign among the batch's campaigns, those campaigns, and the columns, label and weight."""
    x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
    coded = batch.column("_campaign").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), x, batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_w").to_numpy(zero_copy_only=False)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of CHUNK rows or so."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= CHUNK:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _by_campaign(batch: pa.RecordBatch, width: int) -> Iterable[tuple]:
    """(campaign, columns, label, weight) of each campaign's rows in the batch."""
    codes, names, x, y, w = _matrix(batch, width)
    order = np.argsort(codes, kind="stable")
    for i, at in enumerate(np.split(order, np.cumsum(np.bincount(codes, minlength=len(names)))[:-1])):
        if len(at):
            yield names[i], x[at], y[at], w[at]


def _sums_of_fits(a: np.ndarray, y: np.ndarray, w: np.ndarray, betas: np.ndarray) -> np.ndarray:
    """A row for each fit (a column of betas): weight, weight of ones, loss, gradient and upper half of the Hessian by its coefficients."""
    k = a.shape[1]
    eta = a @ betas
    e = np.exp(-np.abs(eta))
    p = np.where(eta >= 0, 1.0, e) / (1 + e)
    wc, yc = w[:, None], y[:, None]
    loss = w @ (np.maximum(eta, 0.0) + np.log1p(e) - yc * eta)
    gradient = a.T @ (wc * (p - yc))
    v = wc * p * (1 - p)
    if betas.shape[1] > 2:  # each pair of columns is multiplied once for all fits
        hessian = np.concatenate([(a[:, i : i + 1] * a[:, i:]).T @ v for i in range(k)])
    else:
        hessian = np.column_stack([(a.T @ (a * v[:, i : i + 1]))[np.triu_indices(k)] for i in range(v.shape[1])])
    ones = np.ones((1, betas.shape[1]))
    return np.concatenate((w.sum() * ones, (w * y).sum() * ones, loss[None, :], gradient, hessian)).T


def _summed(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """Totals of run's (fit, values) over all tasks."""

    def sent(batches):
        for fit, values in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([values], pa.list_(pa.float64()))], names=["fit", "values"])

    partial = rows.mapInArrow(sent, "fit int, values array<double>").select("fit", F.posexplode("values").alias("at", "x"))
    out: dict[int, list] = {}
    for r in partial.groupBy("fit", "at").agg(F.sum("x").alias("x")).orderBy("fit", "at").collect():  # numbers of fits, not of rows
        out.setdefault(r["fit"], []).append(r["x"])
    return {k: np.array(v) for k, v in out.items()}


def campaign_moments(df: DataFrame, columns: list[str], weight: str | None = None) -> dict:
    """campaign -> (weight, sums, sums of squares) of the columns."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = [F.col(c).cast("double") for c in columns]
    rows = df.groupBy("campaign").agg(F.sum(w).alias("w"), F.array(*[F.sum(w * c) for c in x]).alias("s"), F.array(*[F.sum(w * c * c) for c in x]).alias("q")).collect()  # a row a campaign
    return {r["campaign"]: (r["w"], np.array(r["s"], float), np.array(r["q"], float)) for r in rows}


def fit_logistics(df: DataFrame, fits: dict[Hashable, Fit], label: str, weight: str | None = None, steps: int = 40, tolerance: float = 1e-9) -> dict[Hashable, Line]:
    """All fits, by their names. df has campaign, label and the columns without nulls, and is read once for each Newton step, so it is best a written table.

    A fit without rows or with one class alone has no finite maximum: it is left out.
    """
    columns = sorted({c for f in fits.values() for c in f.columns})
    place = {c: i for i, c in enumerate(columns)}
    moments = campaign_moments(df, columns, weight)
    names = list(fits)
    index = [np.array([place[c] for c in fits[k].columns], int) for k in names]
    center, spread = [], []
    for k, cols in zip(names, index, strict=True):
        mine = [moments[c] for c in fits[k].campaigns if c in moments]
        n = sum(m[0] for m in mine)
        s, q = (sum((m[i] for m in mine), np.zeros(len(columns)))[cols] for i in (1, 2))
        mean = s / n if n else s
        sd = np.sqrt(np.maximum(0.0, (q - n * mean * mean) / (n - 1))) if n > 1 else np.zeros(len(cols))
        center.append(mean)
        spread.append(np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, np.inf))  # a constant column gets no coefficient
    members = [frozenset(fits[k].campaigns) for k in names]
    rows = _inputs(df, columns, label, weight)
    width = len(columns)

    # tasks see columns in units of all campaigns together; fit i's own units are own[i] times (1, those)
    n = sum(m[0] for m in moments.values())
    shift = sum((m[1] for m in moments.values()), np.zeros(width)) / n if n else np.zeros(width)
    scale = np.sqrt(np.maximum(0.0, sum((m[2] for m in moments.values()), np.zeros(width)) / n - shift**2)) if n else np.ones(width)
    scale = np.where(scale > 1e-12 * np.maximum(1.0, np.abs(shift)), scale, 1.0)
    own = []
    for i, cols in enumerate(index):
        m = np.diag(np.concatenate(([1.0], scale[cols] / spread[i])))
        m[1:, 0] = (shift[cols] - center[i]) / spread[i]
        own.append(m)
    alike: dict[tuple, list[int]] = {}
    for i, cols in enumerate(index):
        alike.setdefault(tuple(cols.tolist()), []).append(i)

    def sums(theta: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        betas = {i: own[i].T @ b for i, b in theta.items()}

        def run(batches):
            total: dict[int, np.ndarray] = {}
            for chunk in _chunks(batches):
                for c, x, y, w in _by_campaign(chunk, width):
                    a = np.column_stack((np.ones(len(x)), (x - shift) / scale))
                    for cols, fits_of in alike.items():
                        mine = [i for i in fits_of if i in betas and c in members[i]]
                        if not mine:
                            continue
                        found = _sums_of_fits(a[:, [0, *[j + 1 for j in cols]]], y, w, np.column_stack([betas[i] for i in mine]))
                        for i, values in zip(mine, found, strict=True):
                            total[i] = total.get(i, 0.0) + values
            yield from ((i, v.tolist()) for i, v in total.items())

        return {i: in_own_units(own[i], v) for i, v in _summed(rows, run).items()}

    def in_own_units(m: np.ndarray, values: np.ndarray) -> np.ndarray:
        k = len(m)
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = values[3 + k :]
        hessian = m @ (hessian + np.triu(hessian, 1).T) @ m.T
        return np.concatenate((values[:3], m @ values[3 : 3 + k], hessian[np.triu_indices(k)]))

    theta = {i: np.zeros(len(index[i]) + 1) for i in range(len(names))}
    state: dict[int, tuple] = {}  # fit -> (theta, objective, step)
    done: dict[int, np.ndarray] = {}
    for _ in range(steps):
        found = sums(theta)
        nxt = {}
        for i, b in theta.items():
            if i not in found or not 0 < found[i][1] < found[i][0]:
                continue
            n, _, loss = found[i][:3]
            k, penalty = len(b), fits[names[i]].penalty * np.concatenate(([0.0], np.ones(len(b) - 1)))
            value = loss / n + (penalty * b * b).sum() / 2
            if i in state and value > state[i][1] + 1e-13:  # too far: half the step back
                before, objective, step = state[i]
                if np.abs(step).max() < tolerance:
                    done[i] = before
                    continue
                state[i] = (before, objective, step / 2)
                nxt[i] = before + step / 2
                continue
            gradient = found[i][3 : 3 + k] / n + penalty * b
            hessian = np.zeros((k, k))
            hessian[np.triu_indices(k)] = found[i][3 + k :] / n
            hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty)
            step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            if np.abs(step).max() < tolerance:
                done[i] = b + step
                continue
            state[i], nxt[i] = (b, value, step), b + step
        theta = nxt
        if not theta:
            break
    done |= theta
    out = {}
    for i, b in done.items():
        coefficients = b[1:] / spread[i]
        out[names[i]] = Line(fits[names[i]].columns, coefficients, float(b[0] - (coefficients * center[i]).sum()))
    return out


def score_logistics(df: DataFrame, lines: dict[Hashable, Line], wanted: dict[Hashable, dict[str, Iterable]], keys: list[str], name: str = "fit") -> DataFrame:
    """(keys, campaign, name, score): probabilities of the rows of each wanted campaign. wanted: line -> {name to return: campaigns}. One scan for all."""
    columns = sorted({c for line in lines.values() for c in line.columns})
    place = {c: i for i, c in enumerate(columns)}
    jobs: dict = {}
    for k, line in lines.items():
        for shown, campaigns in wanted.get(k, {}).items():
            for c in campaigns:
                jobs.setdefault(c, []).append((shown, np.array([place[x] for x in line.columns], int), line.coefficients, line.intercept))
    rows = _inputs(df, columns, None, None, keys)
    width, kinds = len(columns), {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches):
        for batch in batches:
            codes, names, x, _, _ = _matrix(batch, width)
            for i, c in enumerate(names):
                at = np.flatnonzero(codes == i)
                own = batch.take(pa.array(at))
                for shown, cols, b, b0 in jobs.get(c, ()):
                    score = 1 / (1 + np.exp(-np.clip(x[np.ix_(at, cols)] @ b + b0, -700, 700)))
                    yield pa.RecordBatch.from_arrays([*[own.column(k) for k in keys], own.column("_campaign"), pa.array([shown] * len(at), pa.string()), pa.array(score)], names=[*keys, "campaign", name, "score"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return rows.mapInArrow(run, f"{schema}, campaign {kinds['campaign']}, {name} string, score double")
