"""Choosing a candidate inside each fold, and judging the choice out of time.

Every outer fold (a test campaign and the campaigns that ended before it) picks
its candidate by inner folds made of its training campaigns alone. The fits that
outer and inner folds need are a set keyed by (training campaigns, candidate):
each is made once, however many folds ask for it. All logistic candidates go
through many_fits and share its scans; others are Spark ML fits, side by side.
Predictions are written once and joined with the folds that want them; the
driver holds the calendar of campaigns, whose size the tables' binding checks,
and one score for each fold and candidate.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .many_fits import Fit, fit_logistics, score_logistics

KEYS = ["household_key"]


@dataclass(frozen=True)
class Candidate:
    """complexity: lower is simpler. columns: a logistic regression on these; make: (train) -> scorer with score(df), for anything else."""

    complexity: int
    columns: tuple[str, ...] = ()
    penalty: float = 0.001
    make: Callable | None = None


@dataclass(frozen=True)
class Rules:
    first_test_day: int
    gap: int = 7
    inner_last: int = 6
    min_inner_folds: int = 3
    min_train: tuple[int, int] = (1, 1)
    min_inner_train: tuple[int, int] = (1, 1)
    min_inner_test: tuple[int, int] = (1, 1)
    least_gain: float = 0.002
    near: float = 0.0
    locked: int = 0
    measure: str = "auc"


@dataclass
class Selected:
    """predictions: household_key, campaign, candidate_id, label, score, is_default, chosen, locked, train_set_id. folds: one record for each outer fold. fits: how many were made."""

    predictions: DataFrame
    folds: list[dict] = field(default_factory=list)
    fits: int = 0


def train_set_id(campaigns) -> str:
    return "-".join(str(c) for c in sorted(campaigns))


def choose(scores: dict[str, float], candidates: dict[str, Candidate], default: str, least_gain: float, near: float = 0.0) -> str:
    """The default, unless another gains at least least_gain over it; of those within `near` of the best, the simplest."""
    base = scores.get(default)
    if base is None:
        return default
    best = max(s for s in scores.values() if s is not None)
    good = [k for k, s in scores.items() if k != default and s is not None and s - base >= least_gain and s >= best - near]
    return min(good, key=lambda k: (candidates[k].complexity, -scores[k], k)) if good else default


class Calendar:
    def __init__(self, table: DataFrame, campaigns: DataFrame, label: str):
        counts = {r["campaign"]: (r["n"], r["p"]) for r in table.groupBy("campaign").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(label) > 0).cast("long")).alias("p")).collect()}  # a row a campaign
        rows = campaigns.select("campaign", "start_day", "end_day").collect()  # of a checked size
        self.rows = sorted(((r["start_day"], r["campaign"], r["end_day"]) for r in rows if r["campaign"] in counts))
        self.counts = counts

    def enough(self, campaigns, least: tuple[int, int]) -> bool:
        return all(sum(self.counts[c][i] for c in campaigns) >= least[i] for i in (0, 1))

    def before(self, start: int, gap: int, among=None) -> tuple:
        return tuple(c for _, c, end in self.rows if end < start - gap and (among is None or c in among))

    def outer(self, rules: Rules) -> list[tuple]:
        folds = [(c, self.before(start, rules.gap)) for start, c, _ in self.rows if start >= rules.first_test_day]
        return [(c, train) for c, train in folds if train and self.enough(train, rules.min_train)]

    def inner(self, train: tuple, rules: Rules) -> list[tuple]:
        """Folds inside a training set; none if there is too little finished history to compare candidates."""
        mine = [(start, c) for start, c, _ in self.rows if c in train][-rules.inner_last :]
        folds = [(c, self.before(start, rules.gap, train)) for start, c in mine]
        folds = [(c, t) for c, t in folds if t and self.enough(t, rules.min_inner_train)]
        usable = len(folds) >= rules.min_inner_folds and self.enough([c for c, _ in folds], rules.min_inner_test)
        return folds if usable else []


def fitted_predictions(table: DataFrame, wanted: dict[tuple, set], candidates: dict[str, Candidate], label: str, path: str, parallelism: int = 8) -> tuple[DataFrame, int]:
    """(household_key, campaign, label, train_set_id, candidate_id, score), written to `path`, and the number of fits. wanted: training campaigns -> test campaigns."""
    spark = table.sparkSession
    lines = {(train, k): Fit(train, c.columns, c.penalty) for train in wanted for k, c in candidates.items() if c.make is None}
    others = [(train, k) for train in wanted for k, c in candidates.items() if c.make is not None]
    found = fit_logistics(table, lines, label) if lines else {}
    parts = []
    if found:
        names = {key: {f"{train_set_id(key[0])}|{key[1]}": sorted(wanted[key[0]])} for key in found}
        scored = score_logistics(table, found, names, [*KEYS, label])
        parts.append(scored.select(*KEYS, "campaign", F.col(label).alias("label"), F.substring_index("fit", "|", 1).alias("train_set_id"), F.substring_index("fit", "|", -1).alias("candidate_id"), "score"))
    with ThreadPoolExecutor(parallelism) as pool:
        scorers = list(pool.map(lambda x: candidates[x[1]].make(table.where(F.col("campaign").isin(list(x[0])))), others))
    for (train, k), scorer in zip(others, scorers, strict=True):
        rows = scorer.score(table.where(F.col("campaign").isin(sorted(wanted[train]))))
        parts.append(rows.select(*KEYS, "campaign", F.col(label).alias("label"), F.lit(train_set_id(train)).alias("train_set_id"), F.lit(k).alias("candidate_id"), F.col("score").cast("double").alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path), len(found) + len(others)


def nested_selection(table: DataFrame, campaigns: DataFrame, candidates: dict[str, Candidate], default: str, label: str, rules: Rules, path: str) -> Selected:
    """Every candidate's predictions of every outer test campaign, with the default, the fold's choice and the locked campaigns (the last ones, to be judged once) marked.

    A fold whose training campaigns hold too little finished history keeps the default. Folds with the same training campaigns share the choice.
    """
    calendar = Calendar(table, campaigns, label)
    outer = calendar.outer(rules)
    inner = {train: calendar.inner(train, rules) for _, train in outer}
    wanted: dict[tuple, set] = {}
    for test, train in [*outer, *[f for folds in inner.values() for f in folds]]:
        wanted.setdefault(train, set()).add(test)
    if not wanted:
        raise ValueError("no campaign has finished campaigns enough before it")
    predictions, fits = fitted_predictions(table, wanted, candidates, label, path)
    spark = table.sparkSession

    scores: dict[str, dict[str, float]] = {}
    asks = [(train_set_id(train), train_set_id(t), c) for train, folds in inner.items() for c, t in folds]
    if asks:
        kind = table.schema["campaign"].dataType.simpleString()
        ask = spark.createDataFrame(asks, f"selection string, train_set_id string, campaign {kind}")  # pairs of folds
        rows = predictions.join(F.broadcast(ask), ["train_set_id", "campaign"])
        judged = metrics.measured(rows, ["score"], "label", ["selection", "candidate_id"], ["campaign"])
        for r in judged.select("selection", "candidate_id", rules.measure).collect():  # a number a fold and candidate
            scores.setdefault(r[0], {})[r[1]] = r[2]
    last = {test for test, _ in outer[len(outer) - rules.locked :]} if rules.locked else set()
    folds = []
    for test, train in outer:
        mine = scores.get(train_set_id(train), {})
        pick = choose(mine, candidates, default, rules.least_gain, rules.near) if mine else default
        folds.append({"test_campaign": test, "train_campaigns": sorted(train), "train_set_id": train_set_id(train), "chosen": pick, "inner_scores": mine, "locked": test in last})
    kind = table.schema["campaign"].dataType.simpleString()
    marks = spark.createDataFrame([(f["test_campaign"], f["train_set_id"], f["chosen"], f["locked"]) for f in folds], f"campaign {kind}, train_set_id string, _chosen string, locked boolean")
    rows = predictions.join(F.broadcast(marks), ["campaign", "train_set_id"])
    shown = rows.select(*KEYS, "campaign", "candidate_id", "label", "score", (F.col("candidate_id") == default).alias("is_default"), (F.col("candidate_id") == F.col("_chosen")).alias("chosen"), "locked", "train_set_id")
    return Selected(shown, folds, fits)


def recommended(selected: Selected, candidates: dict[str, Candidate], default: str, rules: Rules) -> tuple[str, dict[str, float]]:
    """The candidate that the outer predictions speak for, by the same rule, without looking at the locked campaigns; and each candidate's score."""
    judged = metrics.measured(selected.predictions.where("not locked"), ["score"], "label", ["candidate_id"], ["campaign"])
    scores = {r["candidate_id"]: r[rules.measure] for r in judged.collect()}  # a row a candidate
    return (choose(scores, candidates, default, rules.least_gain, rules.near) if scores else default), scores
