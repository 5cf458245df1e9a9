"""Product codes of vectors, by active-entry Lloyd.

Vectors become integers and are cut into parts; each part position has a
codebook. A round assigns every part to its nearest entry and moves entries to
the floor of their parts' mean. What is stored of a part is its entry and its
exact squared distance to it. In the next round a part whose entry did not move
compares the entries that did move with that distance, and no others: entries
at rest were no better before and are no better now. A part whose entry moved
scans all entries again. Ties go to the lower index in both cases, so codes are
those of a full scan in every round.

Rows never meet: a round is one pass over a written table whose tasks write the
rows with their new codes and, beside them, the sums and counts of their parts
by entry. The driver gets parts x entries sums in a round, whatever the number
of rows. A round's table is deleted when the one after the next is whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, map_batches, scratch_path, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this size have squared distances whose sum over all parts fits a long, up to 64 components.
LARGEST = 1 << 27


def assign(parts: np.ndarray, book: np.ndarray, moved: np.ndarray | None, codes: np.ndarray | None, distances: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries (lower index on ties) and exact squared distances of the rows of one part position.

    moved tells which entries changed since codes and distances were found; None, that all are new.
    """

    def scan(rows, entries, best, at):
        for j in entries:
            d = ((rows - book[j]) ** 2).sum(axis=1)
            nearer = (d < best) | ((d == best) & (j < at))
            best[nearer], at[nearer] = d[nearer], j
        return at, best

    if moved is None:
        return scan(parts, range(len(book)), np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), len(book)))
    at, best = codes.copy(), distances.copy()
    again = moved[codes]
    active = np.flatnonzero(moved).tolist()
    if active:
        still = np.flatnonzero(~again)
        at[still], best[still] = scan(parts[still], active, best[still], at[still])
        rest = np.flatnonzero(again)
        at[rest], best[rest] = scan(parts[rest], range(len(book)), np.full(len(rest), np.iinfo(np.int64).max), np.full(len(rest), len(book)))
    return at, best


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, floor(scale * component) of each component, of the rows that are kept (see vector_codes)."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(whole & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).select("vec_id", "label", v.alias("v"))


def first_entries(vectors: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest vec_ids, one for each id; tasks send so many rows each."""

    def run(batches):
        best: dict = {}
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if i not in best or v < best[i]:
                    best[i] = v
            best = {i: best[i] for i in sorted(best)[:entries]}
        yield {"vec_id": list(best), "v": list(best.values())}

    kind = vectors.schema["vec_id"].dataType.simpleString()
    sent = map_batches(vectors.where("vec_id is not null").select("vec_id", "v"), run, f"vec_id {kind}, v array<long>")
    rows = sent.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    return np.array([r["v"] for r in rows], np.int64)


def lloyd(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (a byte for each part) and error of each row of `vectors` (as integer_vectors returns them), and the codebooks (part, entry, position)."""
    spark = vectors.sparkSession
    first = first_entries(vectors, entries)
    width = first.shape[1] // parts if len(first) else 0
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy() if len(first) else np.zeros((parts, 0, 0), np.int64)
    moved, state, older = None, vectors, None
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = f"sums boolean, vec_id {kinds['vec_id']}, label {kinds['label']}, v array<long>, code binary, distances array<long>"
    for turn in range(rounds + 1):
        final = turn == rounds
        now, at_rest = books, moved

        def run(batches, now=now, at_rest=at_rest):
            k = now.shape[1]
            sums, counts = np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
            for batch in batches:
                n = len(batch)
                if not n:
                    continue
                x = batch.column("v").flatten().to_numpy().reshape(n, parts, width)
                codes, distances = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
                if at_rest is not None:
                    codes[:] = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, parts)
                    distances[:] = batch.column("distances").flatten().to_numpy().reshape(n, parts)
                for p in range(parts):
                    stored = (None, None, None) if at_rest is None else (at_rest[p], codes[:, p], distances[:, p])
                    codes[:, p], distances[:, p] = assign(x[:, p], now[p], *stored)
                    for j in range(k):
                        own = x[codes[:, p] == j, p]
                        sums[p, j] += own.sum(axis=0)
                        counts[p, j] += len(own)
                packed = codes.astype(np.uint8)
                yield {"sums": [False] * n, "vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": batch.column("v"), "code": [r.tobytes() for r in packed], "distances": list(distances)}
            used = [(p, j) for p in range(parts) for j in range(k) if counts[p, j]]
            yield {"sums": [True] * len(used), "vec_id": [None] * len(used), "label": [None] * len(used), "v": [[int(s) for s in sums[p, j]] for p, j in used], "code": [bytes([p, j]) for p, j in used], "distances": [[int(counts[p, j])] for p, j in used]}

        path = scratch_path(spark, f"codes_{turn}")
        map_batches(state, run, schema).write.partitionBy("sums").parquet(path)
        whole = spark.read.schema(schema).parquet(path)
        state = whole.where("not sums").drop("sums")
        if older:
            deleted(spark, older)
        older = path
        if final:
            break
        totals = whole.where("sums").select("code", F.col("distances")[0].alias("n"), F.posexplode("v").alias("at", "x")).groupBy("code", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        nxt = books.copy()
        for r in totals.collect():  # parts x entries x positions numbers
            nxt[r["code"][0], r["code"][1], r["at"]] = int(r["x"]) // r["n"]
        moved, books = (nxt != books).any(axis=2), nxt
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x)
    return state.select("vec_id", "label", "code", error.alias("error")), books


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error and codebooks_sha256.

    Vectors that are null, empty, of a length that parts do not divide, or with
    null or non-finite components are dropped. If lengths differ, the commonest
    one is coded (the shorter of two), the others are dropped. A component of
    32,768 or more in size stops with an error: its distance would not fit a
    long. Repeated rows are rows each; the first entries are those of the
    smallest distinct vec_ids, of rows with one vec_id the smallest vector. A null vec_id is
    coded and gives no first entry; if all are null there is no codebook and no
    row. Fewer distinct vec_ids than entries make a smaller codebook. Null
    labels are one label. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = written(integer_vectors(vectors, parts), "vectors")
    lengths = kept.groupBy(F.size("v").alias("n")).agg(F.count("vec_id").alias("rows"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("largest"))
    common = lengths.where("rows > 0").orderBy(F.desc("rows"), "n").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if common[0]["largest"] >= LARGEST:
        raise ValueError("a component of 32,768 or more in size: squared distances do not fit a long")
    coded, books = lloyd(kept.where(F.size("v") == common[0]["n"]), parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    by_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "_label")
    both = coded.join(by_label, coded["label"].eqNullSafe(F.col("_label")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes by full scans: each round is a join with all entries of a part."""
    steps = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        f"p AS MATERIALIZED (SELECT r, vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, dense_rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS c FROM p QUALIFY j < {entries})",
    ]
    for i in range(rounds + 1):
        distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)])"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p.p AS p, any_value(x) AS x, min(CAST({distance} AS BIGINT) * {entries} + j) AS best FROM p JOIN b{i} ON p.p = b{i}.p GROUP BY r, p.p)")
        if i < rounds:
            steps.append(f"n{i} AS (SELECT p, best % {entries} AS j, i, CAST(floor(sum(x[i + 1]) / count(*)) AS BIGINT) AS c FROM a{i}, (SELECT unnest(range((SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p AS p, b.j AS j, coalesce(any_value(n.c), any_value(b.c)) AS c FROM b{i} b LEFT JOIN (SELECT p, j, list(c ORDER BY i) AS c FROM n{i} GROUP BY p, j) n ON b.p = n.p AND b.j = n.j GROUP BY b.p, b.j)")
    steps.append(f"e AS (SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (r), s"
