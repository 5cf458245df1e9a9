"""Language-model scores by deleted interpolation.

P(w | v) = a_b c(v,w)/c(v) + d_b c(w)/N + e_b 1/(V+1), where the weights a, d, e
depend on b, the bucket of the context's frequency c(v) (by powers of two). They
are learned by expectation-maximisation: part of the training documents (DEV in
10) is deleted from the counts, and the weights make those documents likeliest
under the counts of the rest. The scores then use the counts of all training documents.

How it runs. Each task packs its documents into blocks of about BLOCK_WORDS words
of one part (counted, deleted, scored only): a block has its own numbering of
word types, and so is small. A block sends each of its distinct words and pairs
once, as sorted 64-bit hashes cut into buckets, to the task that counts that
bucket, and gets the counts over all blocks back in the order it sent them. So a
word that is half of all text costs a block one number, no task holds more than a
bucket or a block, and all is counted over all rows. Buckets follow the
number of shuffle partitions, which is to grow with the data. 64-bit hashes
confuse two of a trillion keys with a probability of a few in ten millions each.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, map_columns, ship, shuffle_partitions, table, written

BLOCK_WORDS, DEV, COUNTED, DELETED, SCORED = 1_000_000, 10, 0, 1, 2
#: Steps of the base-2 logarithm in which EM sees probabilities; frequency buckets.
STEP, FREQUENCIES, LOWEST = 4, 33, -60
BLOCKS = "block long, part int, doc_ids binary, lengths binary, types binary, tokens binary"
KEYS = "bucket int, block long, part int, pairs boolean, keys binary, counts binary"
TOTALS = "block long, part int, bucket int, pairs boolean, n_types long, counted binary, deleted binary"
_BEGIN, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _packed(values: np.ndarray) -> bytes:
    """Integers with their bytes of equal weight together, compressed."""
    import zstandard

    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def _unpacked(data: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenised(docs: DataFrame, part) -> DataFrame:
    """Blocks of documents; part: a column that says what a document is used for."""
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    class Open:
        def __init__(self):
            self.types, self.ids, self.docs, self.words = defaultdict(count(1).__next__), [], [], 0

    def run(batches):
        base, made, parts = TaskContext.get().partitionId() << 32, count(), defaultdict(Open)

        def flush(kind):
            o = parts.pop(kind)
            lengths = np.fromiter(map(len, o.ids), np.int64, len(o.ids)) + 1
            tokens = np.zeros(int(lengths.sum()), np.uint32)  # 0 is the end
            body = np.ones(len(tokens), bool)
            body[np.cumsum(lengths) - 1] = False
            tokens[body] = np.concatenate(o.ids) if o.words else np.empty(0, np.uint32)
            types = np.array([_END, *(xxh64_intdigest(w) for w in o.types)], np.uint64)
            ids = np.array([0 if x is None else x for x in o.docs], np.int64).tobytes() + np.array([x is None for x in o.docs]).tobytes()
            return {"block": [base + next(made)], "part": [kind], "doc_ids": [ids], "lengths": [lengths.tobytes()], "types": [types.tobytes()], "tokens": [_packed(tokens)]}

        for batch in batches:
            for doc_id, text, kind in zip(batch["doc_id"], batch["text"], batch["part"], strict=True):
                o = parts[kind]
                words = text.lower().split()
                o.ids.append(np.fromiter(map(o.types.__getitem__, words), np.uint32, len(words)))
                o.docs.append(doc_id)
                o.words += len(words)
                if o.words + len(o.docs) >= BLOCK_WORDS:
                    yield flush(kind)
        for kind in list(parts):
            yield flush(kind)

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), part.cast("int").alias("part"))
    return map_columns(thin, run, BLOCKS)


class Block:
    """A block's words and pairs: for each, sorted distinct hashes, how often each is in the block, and which one each token has."""

    def __init__(self, row: dict):
        self.tokens = _unpacked(row["tokens"], np.uint32).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        types = np.frombuffer(row["types"], np.uint64)
        first = np.cumsum(self.lengths) - self.lengths
        before = np.concatenate(([0], self.tokens[:-1]))
        before[first] = len(types)  # the begin, as a context
        self.before, n = before, len(types)
        order = np.argsort(types, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.words, self.word_counts = types[order], np.bincount(self.tokens, minlength=n)[order]
        pairs, inverse, counts = np.unique(before * n + self.tokens, return_inverse=True, return_counts=True)
        hashed = _mix(np.append(types, _BEGIN)[pairs // n] * np.uint64(3) + np.uint64(1)) ^ types[pairs % n]
        hashed = _mix(hashed)
        order = np.argsort(hashed, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pairs, self.pair_counts, self.pair_of = hashed[order], counts[order], rank[inverse.ravel()]

    def doc_ids(self, data: bytes) -> list:
        n = len(self.lengths)
        ids, null = np.frombuffer(data[: 8 * n], np.int64).tolist(), np.frombuffer(data[8 * n :], bool)
        return [None if x else i for i, x in zip(ids, null, strict=True)]

    def with_totals(self, rows: list[dict]) -> None:
        """Take the counts over all blocks: c1, c2, c0 are those of each token's word, pair and context."""
        rows.sort(key=lambda r: (r["pairs"], r["bucket"]))
        got = {}
        for pairs in (False, True):
            own = [r for r in rows if r["pairs"] is pairs]
            got[pairs] = [np.concatenate([_unpacked(r[k], np.uint32) for r in own]).astype(np.float64) for k in ("counted", "deleted")]
        self.c1 = [c[self.place[self.tokens]] for c in got[False]]
        end = int(self.place[0])
        of_before = np.append(self.place, end)[self.before]  # as many begins as ends
        self.c0 = [c[of_before] for c in got[False]]
        self.c2 = [c[self.pair_of] for c in got[True]]


def _as_rows(t: pa.Table) -> list[dict]:
    return t.to_pylist()


def count_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket, the counts of the block's keys over all blocks; rows with block -1 have the number of types."""

    def keys(batches):
        for batch in batches:
            for i in range(len(batch["block"])):
                b, block, part = Block({k: v[i] for k, v in batch.items()}), batch["block"][i], batch["part"][i]
                for pairs, hashes, counts in ((False, b.words, b.word_counts), (True, b.pairs, b.pair_counts)):
                    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
                    cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
                    found = [(k, hashes[x:y], counts[x:y]) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                    yield {
                        "bucket": [k for k, _, _ in found], "block": [block] * len(found), "part": [part] * len(found), "pairs": [pairs] * len(found),
                        "keys": [_packed(np.diff(h, prepend=np.uint64(0))) for _, h, _ in found], "counts": [_packed(c.astype(np.uint32)) for _, _, c in found],
                    }

    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("bucket", pa.int32()), ("pairs", pa.bool_()), ("n_types", pa.int64()), ("counted", pa.binary()), ("deleted", pa.binary())])

    def total(group: pa.Table) -> pa.Table:
        out = []
        rows = _as_rows(group)
        for pairs in (False, True):
            own = [r for r in rows if r["pairs"] is pairs]
            if not own:
                continue
            sent = [np.cumsum(_unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in own]
            distinct, inverse = np.unique(np.concatenate(sent), return_inverse=True)
            inverse, sizes = inverse.ravel(), list(map(len, sent))
            part = np.repeat([r["part"] for r in own], sizes)
            counts = np.concatenate([_unpacked(r["counts"], np.uint32) for r in own]).astype(np.float64)
            sums = [np.bincount(inverse[part == k], counts[part == k], len(distinct)).astype(np.uint32) for k in (COUNTED, DELETED)]
            n_types = int(((sums[0] > 0) | (sums[1] > 0)).sum()) if not pairs else 0
            out.append({"block": -1, "part": -1, "bucket": own[0]["bucket"], "pairs": pairs, "n_types": n_types, "counted": b"", "deleted": b""})
            at = np.cumsum([0, *sizes])
            for r, a, b in zip(own, at, at[1:], strict=False):
                of = inverse[a:b]
                out.append({"block": r["block"], "part": r["part"], "bucket": r["bucket"], "pairs": pairs, "n_types": 0, "counted": _packed(sums[0][of]), "deleted": _packed(sums[1][of])})
        return pa.Table.from_pylist(out, schema=schema)

    return map_columns(blocks, keys, KEYS).groupBy("bucket").applyInArrow(total, TOTALS)


def _frequency(c: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for none, then by powers of two."""
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(int) + 1, FREQUENCIES - 1), 0)


def expectation_maximisation(rows: list[tuple[int, int, int, float]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (frequency bucket x pair, word, uniform) from counts of (bucket, step of the pair's probability, step of the word's, n)."""
    weights = np.tile([0.3, 0.6, 0.1], (FREQUENCIES, 1))
    if not rows:
        return weights
    b, p2, p1, n = (np.array(x) for x in zip(*rows, strict=True))
    of = lambda q: np.where(q <= LOWEST * STEP, 0.0, np.exp2(q / STEP))
    p = np.stack([of(p2), of(p1), np.full(len(b), uniform)], axis=1)
    for _ in range(rounds):
        share = weights[b] * p
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(b, share[:, k], FREQUENCIES) for k in range(3)], axis=1)
        seen = sums.sum(axis=1) > 0
        weights[seen] = sums[seen] / sums[seen].sum(axis=1, keepdims=True)
    # a bucket that the deleted documents lack takes the weights of its nearest one; nothing is impossible
    if seen.any():
        known = np.flatnonzero(seen)
        for k in np.flatnonzero(~seen):
            weights[k] = weights[known[np.argmin(np.abs(known - k))]]
    weights = np.maximum(weights, 1e-7)
    return weights / weights.sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame, train) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every document.

    train: a condition on docs, true for the documents to learn from. Null and
    empty texts are one end token. Null and repeated doc_ids and repeated rows
    are each scored (and counted). Other columns are ignored. Without
    training documents all words are equally likely. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    deleted = F.pmod(F.floor(crc_of_id() / 7), F.lit(DEV)) == 0
    part = F.when(~F.coalesce(train, F.lit(False)), SCORED).when(deleted, DELETED).otherwise(COUNTED)
    blocks = written(tokenised(docs, part), "blocks")
    totals = written(count_keys(blocks, 4 * shuffle_partitions(spark)), "totals")
    n_types = totals.where("block = -1").agg(F.sum("n_types")).first()[0] or 0

    def sizes(batches):
        for batch in batches:
            yield {"part": batch["part"], "n": [int(np.frombuffer(x, np.int64).sum()) for x in batch["lengths"]]}

    by_part = dict(map(tuple, map_columns(blocks.select("part", "lengths"), sizes, "part int, n long").groupBy("part").agg(F.sum("n")).collect()))
    n_counted, n_train = by_part.get(COUNTED, 0), by_part.get(COUNTED, 0) + by_part.get(DELETED, 0)
    uniform = 1 / (n_types + 1)
    histogram_schema = pa.schema([("b", pa.int32()), ("p2", pa.int32()), ("p1", pa.int32()), ("n", pa.int64())])

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in _as_rows(left):
            x = Block(row)
            x.with_totals(_as_rows(right))
            c0, c1, c2 = x.c0[0], x.c1[0], x.c2[0]
            step = lambda p: np.where(p > 0, np.round(STEP * np.log2(np.maximum(p, 2.0**LOWEST))), LOWEST * STEP).astype(np.int64)
            q2, q1 = step(c2 / np.maximum(c0, 1)), step(c1 / max(n_counted, 1))
            width = -LOWEST * STEP + 1
            codes, n = np.unique((_frequency(c0) * width - q2) * width - q1, return_counts=True)
            out.append(pa.table([pa.array(codes // width // width, pa.int32()), pa.array(-(codes // width % width), pa.int32()), pa.array(-(codes % width), pa.int32()), pa.array(n, pa.int64())], schema=histogram_schema))
        return pa.concat_tables(out) if out else histogram_schema.empty_table()

    own = blocks.where(F.col("part") == DELETED)
    mine = totals.where(F.col("part") == DELETED).select("block", "bucket", "pairs", "counted", "deleted")
    found = own.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(histogram, "b int, p2 int, p1 int, n long")
    # at most FREQUENCIES * (60 * STEP) ^ 2 rows, whatever the input; in practice some thousands
    weights = expectation_maximisation([tuple(r) for r in found.groupBy("b", "p2", "p1").agg(F.sum("n")).collect()], uniform)
    score_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in _as_rows(left):
            x = Block(row)
            x.with_totals(_as_rows(right))
            c0, c1, c2 = (sum(c) for c in (x.c0, x.c1, x.c2))
            w = weights[_frequency(c0)]
            p = w[:, 0] * c2 / np.maximum(c0, 1) + w[:, 1] * c1 / max(n_train, 1) + w[:, 2] * uniform
            base = np.log10((c1 + 1) / (n_train + n_types + 1))
            first = np.cumsum(x.lengths) - x.lengths
            n = len(first)
            out.append(pa.table([pa.array(x.doc_ids(row["doc_ids"]), pa.int64()), pa.array(x.lengths), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), first)), pa.array(np.full(n, n_train)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))], schema=score_schema))
        return pa.concat_tables(out) if out else score_schema.empty_table()

    every = totals.where("block >= 0").select("block", "bucket", "pairs", "counted", "deleted")
    return blocks.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), crc_of_id() % 7 != 2)
    return scored.select("doc_id", (crc_of_id() % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
