"""Best-fit packing of documents into training sequences, in bounded space.

Pieces arrive one after the other, those of an Arrow batch longest first. A fixed number of sequences is open at any
time; a bitset has bit f set if some open sequence has f tokens free, so the
best fit is its lowest set bit at or above the piece's length. When one more
sequence must open than may be, the fullest open one closes, as it is the least
likely to take another piece.

Each Spark partition packs what it reads, on its own: no shuffle, constant
memory, and a lost task packs its partition again with the same result. The
loss is at most the partly filled sequences that a partition has open at its end.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, map_columns, table
from .pieces import encoder, tokenizer_path

SEQUENCE, OPEN = 2048, 4096


class OpenSequences:
    """The open sequences of one partition: capacity of each, most open at once."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free_set, self.with_free = 0, [[] for _ in range(capacity + 1)]
        self.open, self.next = 0, 0

    def _take(self, free: int) -> int:
        stack = self.with_free[free]
        sequence = stack.pop()
        if not stack:
            self.free_set ^= 1 << free
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece of that many tokens, 1 to capacity."""
        fits = self.free_set >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.open >= self.most_open and length < self.capacity:
                self._take((self.free_set & -self.free_set).bit_length() - 1)
            sequence, free = self.next, self.capacity
            self.next += 1
        left = free - length
        if left:
            self.with_free[left].append(sequence)
            self.free_set |= 1 << left
            self.open += 1
        return sequence, self.capacity - free


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, most_open: int = OPEN, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, the ids as little-endian 32-bit integers.

    A document longer than a sequence is cut into full sequences; what is over
    is its first piece. Shorter documents stay whole. The documents of an Arrow
    batch arrive longest first. Null texts count as empty: a piece with the end
    id alone. Rows with a null or repeated doc_id are packed like any other.
    Other columns are ignored. An empty table gives no rows.
    """
    from pyspark import TaskContext

    tokenizer = tokenizer or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids

    def pieces(batches):
        encode, bins, base = encoder(tokenizer, end_id), OpenSequences(sequence, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            names, found = batch.column("doc_id").to_pylist(), []
            for at, flat, bounds in encode(batch.column("text")):
                data, bounds = flat.tobytes(), bounds.tolist()
                for doc_id, lo, hi in zip(names[at:], bounds[:-1], bounds[1:], strict=False):
                    n = hi - lo
                    cuts = [0, *range(n % sequence or sequence, n, sequence), n] if n > sequence else [0, n]
                    found += [(doc_id, i, a, b - a, data[4 * (lo + a) : 4 * (lo + b)]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            found.sort(key=lambda x: -x[3])
            placed = [bins.place(x[3]) for x in found]
            if found:
                out = dict(zip(("doc_id", "piece", "start", "length"), map(list, zip(*(x[:4] for x in found), strict=True)), strict=True))
                out |= {"ids_crc32": [zlib.crc32(x[4]) for x in found], "sequence_id": [base + s for s, _ in placed], "offset": [o for _, o in placed]}
                yield out | ({"ids": [x[4] for x in found]} if with_ids else {})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), pieces, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack_documents(..., with_ids=True): sequence_id, length, ids (array of int) and doc_ids.

    A group is one sequence, so it holds at most its capacity of tokens.
    """

    def ids(batches):
        for batch in batches:
            yield {"sequence_id": batch["sequence_id"], "length": batch["length"], "doc_ids": batch["doc_ids"],
                   "ids": [np.frombuffer(b"".join(x["ids"] for x in parts), "<u4").astype(np.int32) for parts in batch["parts"]]}

    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    grouped = grouped.withColumn("doc_ids", F.col("parts.doc_id"))
    return map_columns(grouped, ids, "sequence_id long, length long, doc_ids array<long>, ids array<int>")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
