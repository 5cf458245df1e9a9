"""SimHash near-duplicates, with pivot distance tables.

A fingerprint's Hamming distances to many reference fingerprints (pivots) are
its coordinates. By the triangle inequality two fingerprints within `bits` of
each other differ by at most `bits` in every coordinate, so a pair whose
largest coordinate difference is over that is discarded unseen; the survivors
are verified.

Pairs to look at come from coordinates too. The pivots of one family are all
zeros and ones that have ones in only one of SEGMENTS pieces of 16 bits; their
distances together tell those 16 bits, so a family's coordinates agree exactly
if and only if the two fingerprints agree there. Of four pieces, two bits can touch two,
so linked fingerprints agree in at least two families: six tables, each keyed
by a pair of families, bring every linked pair together.

A table's bucket that holds more than BUCKET fingerprints is not paired up:
its members go to a second exact way, in which each gives its 65 fingerprints at a
distance of 0 or 1 and links to the smallest member with the same one. (Two
fingerprints within two bits share such a midpoint, and two that share one are
within two bits.) So work grows with the rows, however dense a group is.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table, text_bytes, written
from .components import components

SEGMENTS, BUCKET, PIVOTS, BITS = 4, 48, 32, 2


def pivots(n: int = PIVOTS, seed: int = 7) -> list[int]:
    """Reference fingerprints in general position for the coordinate test."""
    return [int(x) for x in np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit integer; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, 42)], ">u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], ">u8")
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long). Null texts count as empty: fingerprint zero."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64)
            yield {"doc_id": batch["doc_id"], "fp": fps.view(np.int64)}

    return map_columns(text_bytes(docs), run, "doc_id long, fp long")


def fingerprint_links(fps: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within two bits."""
    if bits != BITS:
        raise ValueError("the tables are laid out for two bits")
    width = 64 // SEGMENTS
    family = [F.shiftright("fp", width * i).bitwiseAND((1 << width) - 1) for i in range(SEGMENTS)]
    keys = [F.shiftleft(family[i], width).bitwiseOR(family[j]).bitwiseOR(F.lit(t << 2 * width)) for t, (i, j) in enumerate(combinations(range(SEGMENTS), 2))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keyed.join(sizes, "key").select("key", "fp", "n"), "buckets")

    left = members.where(F.col("n") <= bucket).select("key", F.col("fp").alias("a"))
    right = left.select("key", F.col("a").alias("b"))
    at = lambda name: F.array(*[F.bit_count(F.col(name).bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p))).cast("tinyint") for p in pivots()])
    a, b = left.withColumn("at_a", at("a")), right.withColumn("at_b", at("b"))
    pairs = a.join(b, "key").where("a < b")
    apart = F.array_max(F.zip_with("at_a", "at_b", lambda x, y: F.abs(x - y)))
    pairs = pairs.where(apart <= bits).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).select("a", "b")

    dense = members.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    near = dense.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    lowest = near.groupBy("middle").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("middle", "low")
    star = near.join(lowest, "middle").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return pairs.union(star)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id of the documents that links of at most two bits reach.

    Texts without words, empty and null ones have fingerprint zero and link like
    any other. Rows of one doc_id are each returned. A null doc_id takes part
    and never names a component unless it has only null ids (then null). Other
    columns are ignored. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low_id")), "distinct")
    of = components(fingerprint_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
