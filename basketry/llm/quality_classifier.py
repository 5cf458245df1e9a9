"""Positive-unlabelled quality classifier.

Trusted positives are rows with quality label 1; every document of the table,
labelled or not, is unlabelled web text. With the squared loss l(z) = (1 - z)^2 / 4,
the non-negative risk

    R(w) = pi * E_p[l(g)]  +  max(0, E_u[l(-g)] - pi * E_p[l(-g)])

of a linear score g = w.x needs only the means and second moments of x over
positives and over all text. Spark sums those over all rows in one pass, so
training covers every document, whatever their number, and the driver works on
two small matrices: where the bracket is negative, the step goes against it, as
the published method does.

The class prior pi is estimated first: positives against all text are ranked by the
same loss at equal weights, and pi is the least ratio, over score thresholds, of the
share of all text above to the share of positives above (with a margin for the
number of rows), read from a histogram of all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, map_columns, table, text_bytes, written
from .quality_features import WIDTH, features

THRESHOLD, RIDGE, BINS = 0.3, 1e-4, 400
#: From g to a score: at this slope a probability (1 + g) / 2 of 0.3 is a score of 0.3.
SLOPE = float(np.log(3 / 7) / (2 * 0.3 - 1))


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and bins (2 bytes for each measure) of every text; null texts count as empty."""

    def run(batches):
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "bins": [x.tobytes() for x in features(batch["text"])]}

    return map_columns(text_bytes(docs), run, "doc_id long, bins binary")


def _matrix(bins: list[bytes]) -> np.ndarray:
    out = np.zeros((len(bins), WIDTH))
    if bins:
        out[np.arange(len(bins))[:, None], np.frombuffer(b"".join(bins), np.uint16).reshape(len(bins), -1)] = 1
    out[:, 0] = 1
    return out


def _sums(rows: DataFrame) -> dict[bool, np.ndarray]:
    """For all rows (False) and for positives (True), the sum of x x'. Column `positive` of rows says which are."""

    def partial(batches):
        total = {False: np.zeros((WIDTH, WIDTH)), True: np.zeros((WIDTH, WIDTH))}
        for batch in batches:
            x, p = _matrix(batch["bins"]), np.array(batch["positive"], bool)
            total[False] += x.T @ x
            total[True] += x[p].T @ x[p]
        for kind, m in total.items():
            yield {"kind": [kind] * WIDTH, "row": list(range(WIDTH)), "sums": list(m)}

    def added(batches):
        total: dict = {}
        for batch in batches:
            for kind, row, sums in zip(batch["kind"], batch["row"], batch["sums"], strict=True):
                total[kind, row] = total.get((kind, row), 0) + np.array(sums)
        if total:
            yield {"kind": [k for k, _ in total], "row": [r for _, r in total], "sums": list(total.values())}

    schema = "kind boolean, row int, sums array<double>"
    parts = map_columns(rows, partial, schema)
    # the rows of all partitions' matrices meet by their number, so no task or driver sees more than WIDTH numbers for each partition and row
    whole = map_columns(parts.repartition(16, "row"), added, schema)
    out = {False: np.zeros((WIDTH, WIDTH)), True: np.zeros((WIDTH, WIDTH))}
    for kind, row, sums in whole.collect():
        out[kind][row] += np.array(sums)
    return out


def _histogram(rows: DataFrame, weights: np.ndarray) -> dict[bool, np.ndarray]:
    """Counts of rows by score bin, from the highest bin down, for all rows and for positives."""

    def run(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            g = np.clip(np.floor((1.5 - _matrix(batch["bins"]) @ weights) / 3 * BINS), 0, BINS - 1).astype(int)
            total[0] += np.bincount(g, minlength=BINS)
            total[1] += np.bincount(g[np.array(batch["positive"], bool)], minlength=BINS)
        yield {"bin": list(range(BINS)), "n": total[0], "p": total[1]}

    parts = map_columns(rows, run, "bin int, n long, p long")
    found = parts.groupBy("bin").agg(F.sum("n"), F.sum("p")).collect()
    out = {False: np.zeros(BINS), True: np.zeros(BINS)}
    for b, n, p in found:
        out[False][b], out[True][b] = n, p
    return out


def estimate_prior(counts: dict[bool, np.ndarray]) -> float:
    n, p = max(counts[False].sum(), 1), max(counts[True].sum(), 1)
    above_n, above_p = np.cumsum(counts[False]) / n, np.cumsum(counts[True]) / p
    use = above_p > 0.1
    margin = 1.5 * (np.sqrt(np.log(10) / (2 * n)) + np.sqrt(np.log(10) / (2 * p)))
    bound = (above_n + margin) / np.maximum(above_p, 1e-9)
    best = int(np.argmin(np.where(use, bound, np.inf)))
    return float(np.clip(above_n[best] / above_p[best], 0.02, 0.98)) if use.any() else 0.5


def minimise(sums: dict[bool, np.ndarray], prior: float, steps: int = 400) -> np.ndarray:
    """Weights of least non-negative risk, from the moments of all rows and of positives."""
    u, p = sums[False] / max(sums[False][0, 0], 1), sums[True] / max(sums[True][0, 0], 1)
    mu, mp = u[0], p[0]
    ridge = RIDGE * np.eye(WIDTH)
    # without the bracket's bound the risk is one quadratic, whose least point is where to begin
    w = np.linalg.solve(u / 2 + ridge, prior * mp - mu / 2)
    rate = 1 / (np.linalg.eigvalsh(u).max() / 2 + RIDGE)
    for _ in range(steps):
        rest = (1 + 2 * mu @ w + w @ u @ w) / 4 - prior * (1 + 2 * mp @ w + w @ p @ w) / 4
        down = (mu + u @ w) / 2 - prior * (mp + p @ w) / 2
        if rest < 0:
            w = w + rate * down  # against the negative part
        else:
            w = w - rate * (prior * (p @ w - mp) / 2 + down + RIDGE * w)
    return w


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and class prior from rows with `bins` and `positive`."""
    sums = _sums(rows)
    if not sums[True][0, 0]:
        return np.zeros(WIDTH), 0.5
    ranker = minimise(sums, 0.5, steps=0)
    prior = estimate_prior(_histogram(rows, ranker))
    return minimise(sums, prior), prior


def classify(docs: DataFrame, labels: DataFrame, learn_from=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every document.

    labels: doc_id and quality; a document with a row of quality 1 is a trusted
    positive, other labels and nulls are not used. learn_from: a condition on
    doc_id for the labels to learn from. Null and empty texts are scored like any other;
    rows of one doc_id are each scored. Without positives every score is 0.5.
    Other columns, clashing names included, are ignored. No rows give no rows.
    """
    trusted = labels.where(F.col("quality") == 1).select("doc_id").where("doc_id is not null").distinct()
    if learn_from is not None:
        trusted = trusted.where(learn_from)
    trusted = trusted.select(F.col("doc_id").alias("_trusted"))
    bins = featured(docs)
    rows = written(bins.join(trusted, bins["doc_id"] == F.col("_trusted"), "left").select("doc_id", "bins", F.col("_trusted").isNotNull().alias("positive")), "features")
    weights, _ = fit(rows)

    def run(batches):
        for batch in batches:
            score = 1 / (1 + np.exp(-SLOPE * np.clip(_matrix(batch["bins"]) @ weights, -20, 20)))
            yield {"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_columns(rows.select("doc_id", "bins"), run, "doc_id long, score double, predicted int")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")
