"""Near copies by the Jaccard similarity of word shingles, verified exactly.

A document's node is a hash of its set of shingles, so texts of equal sets are
one. Pairs to look at come from MinHash bands: BANDS keys of ROWS minima each,
so a pair at similarity 0.8 shares a key with probability 0.9998, closer ones with
more. Each pair is verified on the whole sets.

A key's bucket of over BUCKET nodes is not paired up at first: its members are
compared with the smallest one. Where that leaves a bucket in several
components, its members are dealt in chunks of CHUNK to cells, one for each two
chunks, and pairs not yet linked are compared there; so no pair of a bucket is left
out, and no task holds more than two chunks.

With simhash, SimHash links of op6 are drawn between the same nodes as well, so
a group may hold links of both kinds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, ship, text_bytes, written
from .components import components
from .simhash import fingerprint, fingerprint_links

SHINGLE, SIMILARITY, BANDS, ROWS, BUCKET, CHUNK, MEMO = 5, 0.8, 16, 4, 24, 256, 600_000
_ODD = np.random.default_rng(17).integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxh64_intdigest(word, 42)
        return out


def shingles(text: bytes, words: Words, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles in order; of a shorter text, of all its words; none without words."""
    split = text.lower().split()
    ids = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    if not len(ids):
        return ids
    q = min(shingle, len(ids))
    out = np.full(len(ids) - q + 1, q, np.uint64)
    for j in range(q):
        out = _mix(out * np.uint64(31) + ids[j : len(ids) - q + 1 + j])
    return np.unique(out)


def node_of(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none of the empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 1 << 12):  # bounds the memory
        low = np.minimum(low, (found[a : a + (1 << 12)] * _ODD[:, :1] + _ODD[:, 1:]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(31) + column)
    return key.view(np.int64)


def _sketches(docs: DataFrame, shingle: int, fingerprints: bool = False) -> DataFrame:
    def run(batches):
        words = Words()
        for batch in batches:
            sets = [shingles(t, words, shingle) for t in batch["text"]]
            fps = {"fp": np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)} if fingerprints else {}
            yield {"doc_id": batch["doc_id"], "row": batch["row"], "node": [node_of(s) for s in sets], "n": [len(s) for s in sets], "bands": [bands(s) for s in sets], **fps}

    schema = "doc_id long, row long, node long, n int, bands array<long>" + (", fp long" if fingerprints else "")
    return map_columns(text_bytes(docs).withColumn("row", F.xxhash64("text")), run, schema)


def _sets(docs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of the texts whose hashes are in rows(row)."""

    def run(batches):
        words = Words()
        for batch in batches:
            sets = [shingles(t, words, shingle) for t in batch["text"]]
            yield {"node": [node_of(s) for s in sets], "set": [s.view(np.int64) for s in sets]}

    texts = text_bytes(docs).withColumn("row", F.xxhash64("text")).join(rows, "row", "left_semi").select("text")
    return map_columns(texts, run, "node long, set array<long>").dropDuplicates(["node"])


def _alike(similarity: float):
    """Links of a cell's members (node, root, chunk, set) that are not linked yet."""

    def run(cell: pa.Table) -> pa.Table:
        nodes, roots = cell["node"].to_pylist(), cell["root"].to_pylist()
        sets = [np.asarray(s.values, np.int64) for s in cell["set"]]
        up = {r: r for r in roots}

        def top(r):
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        out = []
        for i in range(len(nodes)):
            for j in range(i):
                a, b = len(sets[i]), len(sets[j])
                if min(a, b) >= similarity * max(a, b) - 1e-9 and top(roots[i]) != top(roots[j]):
                    same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if same >= similarity * (a + b - same) - 1e-9:
                        up[top(roots[i])] = top(roots[j])
                        out.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def links_of(docs: DataFrame, sketches: DataFrame, shingle: int, similarity: float, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all pairs that are similar and share a key."""
    nodes = sketches.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    keyed = nodes.select("node", "row", "n", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("low")).where("size > 1")
    members = written(keyed.join(sizes, "key"), "members")
    sets = written(_sets(docs, members.select("row").distinct(), shingle), "sets")

    left = members.where(F.col("size") <= bucket).select("key", F.col("node").alias("a"), F.col("n").alias("na"))
    right = left.select("key", F.col("a").alias("b"), F.col("na").alias("nb"))
    star = members.where((F.col("size") > bucket) & (F.col("node") != F.col("low.node"))).select(F.col("low.node").alias("a"), F.col("node").alias("b"), F.col("low.n").alias("na"), F.col("n").alias("nb"))
    pairs = left.join(right, "key").where("a < b").select("a", "b", "na", "nb").union(star)
    pairs = pairs.where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9).select("a", "b").distinct()
    of_a, of_b = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    both = pairs.join(of_a, "a").join(of_b, "b").withColumn("same", F.size(F.array_intersect("sa", "sb")))
    found = written(both.where(F.col("same") >= similarity * (F.size("sa") + F.size("sb") - F.col("same")) - 1e-9).select("a", "b"), "similar")

    roots = components(found)
    dense = members.where(F.col("size") > bucket).select("key", "node", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = dense.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    chunks = F.ceil(F.col("size") / chunk).cast("long")
    dealt = written(dense.join(open_keys, "key").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))), "dense")
    if dealt.isEmpty():
        return found
    ship(docs.sparkSession)
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cells = cells.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "root").join(sets, "node")
    more = cells.groupBy("key", "i", "j").applyInArrow(_alike(similarity), "a long, b long")
    return written(found.union(more), "similar")


def simhash_links(sketches: DataFrame) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all texts whose SimHash fingerprints (column fp) are linked as in op6."""
    lowest = written(sketches.groupBy("fp").agg(F.min("node").alias("low")), "fingerprints")
    same = sketches.select("fp", "node").distinct().join(lowest, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    of_a, of_b = (lowest.select(F.col("fp").alias(x), F.col("low").alias(f"low_{x}")) for x in "ab")
    apart = fingerprint_links(lowest.select("fp")).join(of_a, "a").join(of_b, "b").where("low_a <> low_b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    return same.union(apart)


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, simhash: bool = False) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of the documents that links of at least this similarity reach.

    simhash: texts are also linked as in op6, by SimHash fingerprints of three-word shingles that differ in two bits or fewer.
    Texts without words, empty and null ones are copies of each other. Rows of
    one doc_id are each returned. A null doc_id takes part and never names a
    component unless it has only null ids (then null). Other columns are
    ignored. An empty table gives no rows.
    """
    sketches = written(_sketches(docs, shingle, simhash), "sketches")
    links = links_of(docs, sketches, shingle, similarity)
    of = components(links.union(simhash_links(sketches)) if simhash else links)
    ids = written(sketches.groupBy("node").agg(F.min("doc_id").alias("low_id")).join(of, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    lowest = ids.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return sketches.select("doc_id", "node").join(ids.join(lowest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
