"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has VIRTUAL points on a ring of 2^32 places, and every row has one.
A row belongs to the first point at or after its own place; rows that find
their shard full continue clockwise to the next shard with room. Rows arrive in
the order of their places, so the outcome is one fixed function of the rows.
Capacities are rows // shards, and one more for the first rows % shards, so
sizes are at most one apart, whatever the ring looks like.

What must be decided row by row is where an arc of the ring is cut. Rows are
counted by cell (a piece of one arc), so the driver sees one number for each
cell - at most 2^CELL_BITS + shards * VIRTUAL of them, however many rows there
are - and fills the shards arc by arc. Rows then learn their rank in their cell
by a window over (cell), and their shard by a broadcast join with the pieces.
"""

from __future__ import annotations

from bisect import bisect_left
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import table

RING_BITS, CELL_BITS, VIRTUAL = 32, 12, 64


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise. A node's place depends on its shard and number alone, so more shards only add nodes."""
    return sorted((crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(virtual))


def fill(arcs: list[int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, from rank, to rank, shard, first slot) of arcs that hold so many rows each."""
    used, pieces = [0] * len(capacities), []
    clockwise = []
    for a in range(len(owners)):
        seen = list(dict.fromkeys(owners[a:] + owners[:a]))
        clockwise.append(seen)
    for arc, rows in enumerate(arcs):
        at = 0
        for shard in clockwise[arc]:
            if at == rows:
                break
            take = min(rows - at, capacities[shard] - used[shard])
            if take > 0:
                pieces.append((arc, at, at + take, shard, used[shard]))
                used[shard] += take
                at += take
    return pieces


def shard_documents(docs: DataFrame, shards: int = 8, virtual: int = VIRTUAL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and home_shard (where the row would be without bounds).

    law is 'rows': shards differ by at most one row; grown_shard is null, as it
    is for the 'key' law only. Null texts count as empty (size 1); a null
    doc_id is a place of its own on the ring, after which the text decides.
    Rows with equal places are ordered by doc_id and text, so repeated rows
    follow each other and are each given a slot. Other columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    thin = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    nodes = ring(shards, virtual)
    places = [p for p, _ in nodes]
    # places after the last node belong to the first one: an arc of its own, at the end
    owners = [s for _, s in nodes] + [nodes[0][1]]
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32"))), 64 - RING_BITS)
    block = F.shiftright("place", RING_BITS - CELL_BITS).cast("int")
    # for each block of the ring, the index of the first node in it, then the few nodes inside are compared
    starts = [bisect_left(places, b << (RING_BITS - CELL_BITS)) for b in range((1 << CELL_BITS) + 1)]
    inside = [places[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    lookup = spark.createDataFrame([(b, starts[b], inside[b]) for b in range(1 << CELL_BITS)], "block int, first int, inside array<long>")
    placed = thin.withColumn("place", place).withColumn("block", block).join(F.broadcast(lookup), "block")
    placed = placed.withColumn("arc", F.col("first") + F.size(F.filter("inside", lambda p: p < F.col("place")))).drop("first", "inside")

    counts = {(r["arc"], r["block"]): r["n"] for r in placed.groupBy("arc", "block").agg(F.count(F.lit(1)).alias("n")).collect()}
    arcs, before = [0] * len(owners), []
    for (arc, cell), n in sorted(counts.items()):
        before.append((arc, cell, arcs[arc]))
        arcs[arc] += n
    rows = sum(arcs)
    pieces = fill(arcs, owners, [rows // shards + (s < rows % shards) for s in range(shards)])
    cells = spark.createDataFrame([(arc, cell, n, owners[arc]) for arc, cell, n in before], "arc int, block int, before long, home_shard int")
    cuts = spark.createDataFrame(pieces, "arc int, begins long, ends long, shard int, first_slot long")

    in_cell = W.Window.partitionBy("arc", "block").orderBy("place", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(in_cell) - 1).join(F.broadcast(cells), ["arc", "block"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    found = ranked.join(F.broadcast(cuts), (ranked["arc"] == cuts["arc"]) & (F.col("rank") >= F.col("begins")) & (F.col("rank") < F.col("ends")))
    slot = F.col("first_slot") + F.col("rank") - F.col("begins")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """The documents of a table with one row a doc_id, as Parquet in a folder for each shard, in the order of their slots."""
    of = sharded.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    both = docs.join(of, docs["doc_id"].eqNullSafe(F.col("_id"))).drop("_id")
    both.sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
