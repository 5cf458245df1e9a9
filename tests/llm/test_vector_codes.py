import hashlib
import math
import random

import numpy as np
import pytest

from basketry.llm import vector_codes as V


def brute(rows, parts=8, entries=16, rounds=6):
    """rows (vec_id, vector, label) with full scans in every round."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    lengths = {}
    for i, v, _ in kept:
        lengths[len(v)] = lengths.get(len(v), 0) + (i is not None)
    length = min((-n, k) for k, n in lengths.items())[1]
    kept = [(i, v, label) for i, v, label in kept if len(v) == length]
    w = length // parts
    first = {}
    for i, v, _ in kept:
        if i is not None and (i not in first or v < first[i]):
            first[i] = v
    seeds = [first[i] for i in sorted(first)[:entries]]
    books = [[s[p * w : p * w + w] for s in seeds] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in kept:
                x = v[p * w : p * w + w]
                got.setdefault(near(x, books[p])[1], []).append(x)
            for j, xs in got.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        best = [near(v[p * w : p * w + w], books[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in best), error, label))
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=str)


def got(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return sorted((tuple(r) for r in V.vector_codes(frame).collect()), key=str)


def vectors(n, dim, seed=1, grid=None):
    rng = random.Random(seed)
    draw = (lambda: float(np.float32(rng.choice(grid)))) if grid else (lambda: float(np.float32(rng.gauss(0, 0.3))))
    return [(rng.randrange(-5, 5 * n), [draw() for _ in range(dim)], rng.choice([0, 0, 0, 1, None])) for _ in range(n)]


def test_codes_of_full_scans_and_odd_rows(spark):
    rows = vectors(120, 16)
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 15, 2), (903, [0.5] * 8, 2), (904, [float("nan")] * 16, 0), (905, [float("inf")] * 16, 0), (906, [None] + [0.1] * 15, 0)]
    rows += [(None, [0.25] * 16, 5), rows[3], rows[3], (rows[4][0], [-1.5] * 16, None), (907, [30000.0] * 16, 9)]
    assert got(spark, rows) == brute(rows)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, v, label) for i, (_, v, label) in enumerate(vectors(90, 8, 2, [-1, 0, 1, 2]))]
    assert got(spark, rows) == brute(rows)


def test_few_none_and_too_large(spark):
    rows = vectors(5, 8, 3)
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == got(spark, [(1, None, 1)]) == got(spark, [(None, [0.5] * 8, 1)]) == []
    with pytest.raises(ValueError, match="32,768"):
        got(spark, [(1, [1e30] * 8, 1)])


def test_a_round_after_moves_equals_a_scan_of_all():
    rng = np.random.default_rng(4)
    x, book = rng.integers(-4, 5, (400, 2)), rng.integers(-4, 5, (9, 2))
    at, best = V.assign(x, book, None, None, None)
    for _ in range(20):
        moved = rng.random(9) < 0.3
        book = np.where(moved[:, None], rng.integers(-4, 5, (9, 2)), book)
        at, best = V.assign(x, book, moved, at, best)
        d = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = vectors(30, 8, 5)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *(F.lit("x").alias(c) for c in ("v", "code", "sums", "distances", "error", "_label")))
    assert sorted((tuple(r) for r in V.vector_codes(frame).collect()), key=str) == brute(rows)
