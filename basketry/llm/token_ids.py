"""Token-id files in Simple-8b.

Format. A token-id file set is a Parquet folder; each row is one chunk of whole
documents in ascending doc_id order:

  part, chunk      order of the chunks: all of part 0, then part 1, ...
  first            ids of the same part before this chunk
  n_tokens         ids in the chunk, end ids included
  doc_ids, lengths the documents' ids and id counts
  offsets          index in `words` where each block of BLOCK ids begins
  words            the ids, as little-endian 64-bit Simple-8b words

A word has its selector in the top 4 bits and COUNTS[selector] ids of
WIDTHS[selector] bits below, the first id lowest. Selector 0 is the escape: the
id, too wide for 60 bits, is the whole next word. The last word of a block is
padded with zeros. As blocks begin at known words, a reader may decode all
blocks at once or only some.

Spark's Parquet committer makes the files whole or absent, also when an
executor is lost midway.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, map_columns, scratch_path, shuffle_partitions, table
from .pieces import encoder, tokenizer_path

BLOCK, PAD = 1024, 120
#: Fixed values of the coding: selector -> ids a word and bits an id.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
FILE_SCHEMA = "part int, chunk long, first long, n_tokens long, doc_ids binary, lengths binary, offsets binary, words binary"
CHUNK_TOKENS = 1 << 20


_SHORT = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if ids.max() < len(_SHORT):
        return _SHORT[ids]
    high = ids >> np.uint64(32)
    wide = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], 0)
    return np.maximum(wide, np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)


def simple8b_encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the word offset of each block of BLOCK ids."""
    n = len(ids)
    rows = -(-n // BLOCK)
    if not rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grid = np.zeros((rows, BLOCK + PAD), np.uint64)
    flat = np.zeros(rows * BLOCK, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK] = flat.reshape(rows, BLOCK)
    bits = _bits(grid.ravel()).reshape(grid.shape)

    # widest[k][i]: the most bits among the k ids from i on, from shorter windows
    def ahead(a: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(a)
        out[:, :-by] = a[:, by:]
        return out

    widest = {1: bits}
    for k in (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120):
        half = max(x for x in widest if x < k and 2 * x >= k)
        widest[k] = np.maximum(widest[half], ahead(widest[half], k - half))
    selector = np.full(bits.shape, 255, np.uint8)
    for s in range(len(COUNTS)):  # the fullest selector that fits, which is the lowest, or else the escape
        misfit = (widest[int(COUNTS[s])] > WIDTHS[s]).view(np.uint8) if s else np.uint8(1)
        selector = np.minimum(selector, misfit * np.uint8(16) + np.uint8(s))
    selector &= 15

    # all blocks step through their ids side by side
    length = np.full(rows, BLOCK)
    length[-1] = n - (rows - 1) * BLOCK
    place = np.arange(rows) * (BLOCK + PAD)
    end, sel, begins = place + length, selector.ravel(), np.zeros(selector.size, bool)
    while len(place):
        begins[place] = True
        place = place + COUNTS[sel[place]]
        more = place < end
        if not more.all():
            place, end = place[more], end[more]
    starts = np.flatnonzero(begins)
    blocks = starts // (BLOCK + PAD)
    kinds, source = sel[starts], grid.ravel()
    words = np.zeros(len(starts), np.uint64)
    for s in np.unique(kinds):
        mine = np.flatnonzero(kinds == s)
        value = np.zeros(len(mine), np.uint64)
        if s and WIDTHS[s]:
            for j in range(int(COUNTS[s])):
                value |= source[starts[mine] + j] << np.uint64(j * int(WIDTHS[s]))
        words[mine] = value | np.uint64(int(s) << 60)
    escaped = kinds == 0
    if escaped.any():
        words = np.insert(words, np.flatnonzero(escaped) + 1, source[starts[escaped]])
    counts = np.bincount(blocks, minlength=rows) + np.bincount(blocks[escaped], minlength=rows)
    return words, np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)


def simple8b_decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of simple8b_encode, all blocks at once."""
    rows = len(offsets)
    if not rows:
        return np.empty(0, np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kinds == 0):  # an escaped word may itself look like a selector 0
        if not raw[i]:
            raw[i + 1] = True
    counts = np.where(raw, 0, COUNTS[kinds])
    before = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    target = block * (BLOCK + PAD) + before - before[offsets][block]
    grid = np.zeros(rows * (BLOCK + PAD), np.uint64)
    for s in np.unique(kinds[~raw]):
        mine = np.flatnonzero((kinds == s) & ~raw)
        if s == 0:
            grid[target[mine]] = words[mine + 1]
        elif WIDTHS[s]:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for j in range(int(COUNTS[s])):
                grid[target[mine] + j] = (words[mine] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return grid.reshape(rows, -1)[:, :BLOCK].ravel()[:n]


def write_token_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None) -> None:
    """Encode every text and write a token-id file set to path, in ascending doc_id order.

    A null text counts as empty (only its end id is written). Null doc_ids come
    first; rows of one doc_id follow each other in the order of their texts;
    repeated rows are each written. Other columns are ignored. An empty table
    gives a file set without chunks.
    """
    from pyspark import TaskContext

    tokenizer = tokenizer or tokenizer_path()
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = partitions or shuffle_partitions(docs.sparkSession)
    ordered = thin.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def chunks(batches):
        encode, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        chunk = first = held = 0
        ids, lengths, known, null = [], [], [], []

        def flush():
            flat = np.concatenate(ids)
            words, offsets = simple8b_encode(flat.astype(np.uint64))
            return {"part": [part], "chunk": [chunk], "first": [first], "n_tokens": [len(flat)], "doc_ids": [np.concatenate(known).astype("<i8").tobytes() + np.concatenate(null).tobytes()],
                    "lengths": [np.concatenate(lengths).astype("<i8").tobytes()], "offsets": [offsets.astype("<i8").tobytes()], "words": [words.astype("<u8").tobytes()]}

        for batch in batches:
            names = batch.column("doc_id")
            values, missing = names.fill_null(0).to_numpy(zero_copy_only=False), names.is_null().to_numpy(zero_copy_only=False)
            for at, flat, bounds in encode(batch.column("text")):
                ids.append(flat)
                lengths.append(np.diff(bounds))
                known.append(values[at : at + len(bounds) - 1])
                null.append(missing[at : at + len(bounds) - 1])
                held += len(flat)
                if held >= CHUNK_TOKENS:
                    yield flush()
                    chunk, first, held = chunk + 1, first + held, 0
                    ids, lengths, known, null = [], [], [], []
        if ids:
            yield flush()

    map_batches(ordered, chunks, FILE_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document of a token-id file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with_ids, ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one row a part: as many as the writer had partitions
    bases, total = [], 0
    for part, n in files.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base long")
    schema = "part int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches):
        for batch in batches:
            for part, first, n, doc_ids, lengths, offsets, words in zip(*(batch[k] for k in ("part", "first", "n_tokens", "doc_ids", "lengths", "offsets", "words")), strict=True):
                ids = simple8b_decode(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<i8"), n).astype("<u4")
                lengths = np.frombuffer(lengths, "<i8")
                count = len(lengths)
                known, null = np.frombuffer(doc_ids[: 8 * count], "<i8"), np.frombuffer(doc_ids[8 * count :], bool)
                starts = np.cumsum(lengths) - lengths
                cut = [ids[a : a + b] for a, b in zip(starts, lengths, strict=True)]
                out = {"part": [part] * count, "doc_id": [None if x else int(y) for x, y in zip(null, known, strict=True)],
                       "local": starts + first, "n_tokens": lengths, "ids_crc32": [zlib.crc32(x.tobytes()) for x in cut]}
                if with_ids:
                    out["ids"] = [x.astype(np.int64) for x in cut]
                yield out

    rows = map_columns(files.select("part", "first", "n_tokens", "doc_ids", "lengths", "offsets", "words"), documents, schema)
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_ids")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return read_token_ids(spark, path)
