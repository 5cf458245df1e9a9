"""Removal of byte strings that repeat across documents, by suffix order.

Every string of `match` bytes contains a core: of its substrings of CORE bytes
(half a string) the leftmost with the smallest hash. Neighbouring strings with
the same core are one fragment, so a fragment is at most 1.5 strings long and
all equal strings of the corpus lie in fragments with equal cores. Documents
are written as blocks of some MB. First each block sends the hashes of its
cores, 28 bits each, to be told those that another block has too. Then only
fragments whose core is in several blocks, or in several documents of their own
block, are dealt to buckets by their cores, packed into compressed blobs; a
bucket is a few MB whatever the size of the corpus, for their number grows with
it. A core that is taken for shared by mistake (equal short hashes) costs its
fragments' way and no more.

In a bucket, the fragments whose cores occur in several documents are joined to one text,
whose suffixes are sorted; the Burrows-Wheeler transform of that order is
extended backwards, breadth first: from the interval of each string to those of
the strings with one more character before it. The end of an interval that is
seen for the first time in round n is a place where neighbours have n bytes in
common, so common prefixes come by increasing value, an interval whose end is
known is not followed, and after `match` rounds the places still open have at
least `match` bytes in common. The runs between are the repeated strings; each
takes the smallest doc_id of its suffixes.

Skew: a block is searched for equal fragments first. Of
those, only the ones of the smallest doc_id are sent on; the others start in a
document with a smaller doc_id by definition. So a passage that a third of all
documents share sends a row for each block, not for each document. A bucket
that is still over LIMIT bytes (one core in very many surroundings) is not
held: its fragments are dealt again by cores that are longer to the left or to
the right, each string by one of them, until the core is the whole string.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, map_batches, scratch_path, table, written

MATCH, CHUNK, BLOCK, BUCKET, LIMIT, TEXT = 50, 1 << 20, 1 << 22, 1 << 24, 1 << 26, 1 << 20
_RANDOM = np.random.default_rng(12).integers(0, 1 << 63, 320, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE, _STEP, _LAST = _RANDOM[:256], _RANDOM[256:316], _RANDOM[316:]


def core_length(match: int) -> int:
    return match // 2 - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _LAST[0]
    return h ^ (h >> np.uint64(29))


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place on."""
    h, size, step = _BYTE[data], 1, 0
    while 2 * size <= n:
        h, size, step = h[:-size] * _STEP[step] + h[size:], 2 * size, step + 1
    if size < n:
        h = h[: len(h) - (n - size)] * _STEP[step] + h[n - size :]
    return _mixed(h)


def leftmost_minima(h: np.ndarray, window: int) -> np.ndarray:
    """For each place, where the leftmost smallest value of the `window` values from there on is."""
    at, size = np.arange(len(h), dtype=np.int32), 1

    def joined(h, at, apart):
        right = h[apart:] < h[:-apart]
        return np.where(right, h[apart:], h[:-apart]), np.where(right, at[apart:], at[:-apart])

    while 2 * size <= window:
        (h, at), size = joined(h, at, size), 2 * size
    return joined(h, at, window - size)[1] if size < window else at


def planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: this compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: str, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending numbers of 32 bits as compressed differences."""
    return zstandard.compress(planes(np.diff(keys, prepend=np.uint32(0))), 1)


def unpacked_keys(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    return np.cumsum(from_planes(raw, "u4", len(raw) // 4), dtype=np.uint32)


def equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct text, for each row the number of its text); by a hash, checked byte by byte."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words, h = wide.view(np.uint64), np.zeros(len(rows), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * _STEP[i]
        h ^= h >> np.uint64(29)
    _, lead, of = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(words, words[lead[of]]):  # two texts with one hash
        _, lead, of = np.unique(rows.view(f"S{rows.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    return lead, of


class Fragments:
    """Columns of fragments: key (hash of the core; on the way its upper half, for the lower has chosen the bucket), doc, variant (tells documents with one doc_id apart), pos (in the document), off (of the core in the fragment), size, at (in data)."""

    PLAIN = (("key", "u4"), ("doc", "i8"), ("variant", "u4"), ("pos", "i8"), ("off", "u1"), ("size", "u1"))

    def __init__(self, data: np.ndarray, **columns: np.ndarray):
        self.data, self.columns = data, columns

    def __getattr__(self, name):
        try:
            return self.columns[name]
        except KeyError:
            raise AttributeError(name) from None

    def __len__(self):
        return len(self.columns["key"])

    def take(self, index) -> Fragments:
        return Fragments(self.data, **{k: v[index] for k, v in self.columns.items()})

    def matrix(self, width: int) -> np.ndarray:
        """The bytes of each fragment in a row of `width` (zeros after its end), and its size in one column more, which is never zero."""
        padded = np.concatenate((self.data, np.zeros(width, np.uint8)))
        out = np.lib.stride_tricks.sliding_window_view(padded, width)[self.at] * (np.arange(width) < self.size[:, None])
        return np.ascontiguousarray(np.column_stack((out, self.size)).astype(np.uint8))

    def packed(self) -> bytes:
        sizes = self.size.astype(np.int64)
        ends = np.cumsum(sizes)
        flat = self.data[np.repeat(self.at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        columns = self.columns | {"key": self.key >> np.uint64(32)}
        plain = b"".join(planes(columns[k].astype(t)) for k, t in self.PLAIN)
        return b"F" + zstandard.compress(struct.pack("<q", len(self)) + plain + flat.tobytes(), 3)

    @classmethod
    def joined(cls, blobs: list[bytes]) -> Fragments:
        columns, texts, before = [], [], 0
        for blob in blobs:
            raw = zstandard.decompress(blob[1:])
            n, at, own = struct.unpack("<q", raw[:8])[0], 8, {}
            for k, t in cls.PLAIN:
                own[k] = from_planes(raw, t, n, at)
                at += n * np.dtype(t).itemsize
            ends = np.cumsum(own["size"].astype(np.int64))
            own["at"] = before + ends - own["size"]
            before += len(raw) - at
            columns.append(own)
            texts.append(np.frombuffer(raw, np.uint8, len(raw) - at, at))
        return cls(np.concatenate(texts), **{k: np.concatenate([c[k] for c in columns]) for k in columns[0]})


def fragments(data: np.ndarray, bounds: np.ndarray, docs: np.ndarray, variants: np.ndarray, match: int) -> Fragments:
    """The fragments of texts that stand one after the other; a column `same` more: hash of a whole fragment."""
    core = core_length(match)
    window, found = match - core + 1, []
    cuts = [0]
    for end in bounds[1:].tolist():  # whole texts up to CHUNK bytes together, longer ones in pieces
        while end - cuts[-1] > CHUNK:
            inner = bounds[np.searchsorted(bounds, cuts[-1] + CHUNK, side="right") - 1]
            cuts.append(int(inner) if inner > cuts[-1] else cuts[-1] + CHUNK)
    cuts.append(len(data))
    for begin, end in zip(cuts, cuts[1:], strict=False):
        piece = data[begin : end + match]
        if len(piece) < match:
            continue
        h = grams(piece, core)
        anchor = leftmost_minima(h, window)[: end - begin]  # one for each string of match bytes
        lo, hi = np.searchsorted(bounds, [begin, begin + len(piece)], side="right") - 1
        inner = np.clip(bounds[lo : hi + 2], begin, begin + len(piece))
        text = np.repeat(np.arange(len(inner) - 1), np.diff(inner))
        inside = text[: len(anchor)] == text[match - 1 : match - 1 + len(anchor)]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
        a, b = np.flatnonzero(first), np.flatnonzero(last) + match
        same = _mixed(h[a] * _STEP[40] + h[a + core] * _STEP[41] + h[b - core] * _STEP[42] + h[b - 2 * core] * _STEP[43] + (b - a).astype(np.uint64))
        row = lo + text[a]
        found.append((h[anchor[a]], docs[row], variants[row], begin + a - bounds[row], anchor[a] - a, b - a, begin + a, same))
    names = ("key", "doc", "variant", "pos", "off", "size", "at", "same")
    kinds = ("u8", "i8", "u4", "i8", "i8", "i8", "i8", "u8")
    return Fragments(data, **{n: np.concatenate([np.zeros(0, t), *(x[i] for x in found)]).astype(t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))})


def local_repeats(own: Fragments) -> tuple[Fragments, Fragments]:
    """(fragments to send, fragments that equal one of a smaller doc_id here). The fragments come in ascending order of doc."""
    order = np.argsort(own.same, kind="stable")
    same = own.same[order]
    begins = np.concatenate(([True], same[1:] != same[:-1]))[: len(order)]
    lead = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))] if len(order) else order
    check = (own.doc[order] > own.doc[lead]) & (own.size[order] == own.size[lead])
    at, to, size = own.at[order][check], own.at[lead][check], own.size[order][check]
    equal = np.ones(len(at), bool)
    for t in range(int(size.max()) if len(size) else 0):
        equal &= (t >= size) | (own.data[np.minimum(at + t, len(own.data) - 1)] == own.data[np.minimum(to + t, len(own.data) - 1)])
    removed = np.zeros(len(order), bool)
    removed[order[np.flatnonzero(check)[equal]]] = True
    return own.take(np.flatnonzero(~removed)), own.take(np.flatnonzero(removed))


def merged(doc: np.ndarray, variant: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of spans, by document."""
    order = np.lexsort((begin, variant, doc))
    doc, variant, begin, end = doc[order], variant[order], begin[order], end[order]
    if not len(doc):
        return doc, variant, begin, end
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])))
    far = end + np.cumsum(new) * (np.int64(1) << 40)  # ends of later documents are beyond all before
    reach = np.maximum.accumulate(far)
    shifted = begin + np.cumsum(new) * (np.int64(1) << 40)
    opens = new | np.concatenate(([True], shifted[1:] > reach[:-1]))
    starts = np.flatnonzero(opens)
    return doc[starts], variant[starts], begin[starts], np.maximum.reduceat(end, starts)


def suffix_order(symbols: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in ascending order; each ends at the first 0, of which `left` says how far it is. Equal ones are in the order of their places."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(7, np.int64)))
    for t in range(7):
        key = key << 9 | np.where(t < left, padded[t : t + n], 0)
    reach = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        if reach > longest:
            return np.argsort(rank, kind="stable")
        ahead = np.minimum(np.arange(n) + reach, n - 1)
        key = rank << 32 | np.where(reach <= left, rank[ahead] + 1, 0)
        reach *= 2


def closed_places(symbols: np.ndarray, order: np.ndarray, match: int) -> np.ndarray:
    """n + 1 flags: is place i the border of suffixes i - 1 and i with fewer than `match` symbols in common, by backward extension of the transform."""
    n = len(symbols)
    bwt = symbols[order - 1].astype(np.int64)
    by_symbol = np.argsort(bwt, kind="stable")
    places = bwt[by_symbol] * (n + 1) + by_symbol
    target = np.empty(n, np.int64)
    target[by_symbol] = np.arange(n)
    before = np.full(n, -1, np.int64)
    alike = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    before[by_symbol[1:][alike]] = by_symbol[:-1][alike]
    closed = np.zeros(n + 1, bool)
    closed[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(match):
        width = high - low
        ends = np.cumsum(width)
        inside = np.repeat(low - (ends - width), width) + np.arange(ends[-1] if len(ends) else 0)
        first = (before[inside] < np.repeat(low, width)) & (bwt[inside] > 0)  # once for each symbol before an interval
        place = inside[first]
        low = target[place]
        high = np.searchsorted(places, bwt[place] * (n + 1) + np.repeat(high, width)[first])
        open_ = ~closed[high]
        low, high = low[open_], high[open_]
        closed[high] = True
        if not len(low):
            break
    return closed


def smallest_docs(texts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, match: int) -> np.ndarray:
    """For each of the texts (a matrix) and each start of a string of `match` bytes, the smallest of docs whose text has the same string; elsewhere, the largest long."""
    n_texts, longest = texts.shape
    wide = np.zeros((n_texts, longest + 1), np.uint16)
    wide[:, :-1] = texts.astype(np.uint16) + 1
    used = np.arange(longest + 1) <= sizes[:, None]
    wide[np.arange(n_texts), sizes] = 0
    symbols = wide[used]
    row, column = np.nonzero(used)
    left = sizes[row] - column
    order = suffix_order(symbols, left, longest)
    border = closed_places(symbols, order, match)[:-1]
    short = left[order] < match
    border |= short
    border[1:] |= short[:-1]
    begins = np.flatnonzero(border)
    least = np.minimum.reduceat(docs[row[order]], begins)
    of = np.full((n_texts, longest - match + 1), np.iinfo(np.int64).max)
    whole = ~short
    at = order[whole]
    of[row[at], column[at]] = least[np.cumsum(border) - 1][whole]
    return of


def bucket_repeats(own: Fragments, match: int) -> tuple[np.ndarray, ...]:
    """(doc, variant, begin, end) of what is removed in the fragments of a bucket."""
    width = 2 * match - core_length(match)
    order = np.lexsort((own.doc, own.key))
    key, doc = own.key[order], own.doc[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    ends = np.append(begins[1:], len(key))
    several = np.repeat(doc[begins] < doc[ends - 1], ends - begins) if len(key) else np.zeros(0, bool)
    own = own.take(order[several])
    out = [np.zeros(0, t) for t in ("i8", "u4", "i8", "i8")]
    # keys stay together; a text to sort has TEXT bytes or one key
    borders = np.flatnonzero(np.concatenate(([True], own.key[1:] != own.key[:-1]))[: len(own)])
    totals = np.concatenate(([0], np.cumsum(own.size.astype(np.int64))))
    at = 0
    while at < len(borders):
        to = max(at + 1, int(np.searchsorted(totals[borders], totals[borders[at]] + TEXT, side="right")) - 1)
        group = own.take(slice(borders[at], borders[to] if to < len(borders) else len(own)))
        rows = group.matrix(width)
        lead, of = equal_rows(rows)
        least = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(least, of, group.doc)
        sizes = rows[lead, -1].astype(np.int64)
        # a text that no other shares a core with has its strings alone: nothing is to be ordered
        _, number, texts = np.unique(group.key[lead], return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(texts[number] > 1)
        low = np.where(np.arange(width - match + 1) <= sizes[:, None] - match, least[:, None], np.iinfo(np.int64).max)
        if len(mixed):
            low[mixed] = smallest_docs(rows[lead[mixed], :-1], sizes[mixed], least[mixed], match)
        gone = low[of] < group.doc[:, None]
        hit = gone.any(axis=1)
        # strings of one fragment start less than `match` apart, so what they cover is one span
        begin, end = gone.argmax(axis=1), gone.shape[1] - gone[:, ::-1].argmax(axis=1) - 1 + match
        for i, x in enumerate((group.doc, group.variant, group.pos + begin, group.pos + end)):
            out[i] = np.concatenate((out[i], x[hit]))
        at = to
    return tuple(out)


def finer(own: Fragments, match: int, core: int) -> Fragments:
    """The fragments cut in two: strings that reach far to the left of the core (of `core` bytes), and the others; cores grow on that side by half of what they leave over."""
    ext = -(-(match - core) // 2)
    out = []
    off, size, at, pos = (own.columns[c].astype(np.int64) for c in ("off", "size", "at", "pos"))
    cut = off - ext  # strings of the left half start here or before
    for side, keep, begin, end in ((0, cut >= 0, np.zeros_like(off), np.minimum(cut + match, size)), (1, cut + 1 <= size - match, np.maximum(cut + 1, 0), size)):
        i = np.flatnonzero(keep)
        new_off = (cut if side == 0 else off - begin)[i]
        begin, end = begin[i], end[i]
        h = np.full(len(i), _STEP[50 + side])
        for t in range(core + ext):
            h = (h ^ _BYTE[own.data[at[i] + begin + new_off + t]]) * _STEP[52]
            h ^= h >> np.uint64(31)
        out.append({"key": _mixed(h), "doc": own.doc[i], "variant": own.variant[i], "pos": pos[i] + begin, "off": new_off, "size": end - begin, "at": at[i] + begin})
    return Fragments(own.data, **{k: np.concatenate([o[k] for o in out]) for k in out[0]})


def dealt(own: Fragments, buckets: int):
    """Rows (bucket, blob) of fragments."""
    if not len(own):
        return
    bucket = (own.key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(ordered)], strict=True):
        yield int(ordered[a]), own.take(order[a:b]).packed()


def blocks_of(docs: DataFrame) -> DataFrame:
    """Rows (block, docs, text): some documents in ascending order of doc. docs has doc, variant and text (bytes). The numbers of blocks are those of one attempt of a task, so the rows are to be written before use."""

    def run(batches):
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            order = np.argsort(doc, kind="stable")
            batch = batch.take(pa.array(order))
            doc, variant, texts = doc[order], batch.column("variant").to_numpy().astype(np.uint32), batch.column("text")
            bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(doc):
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK, side="right")) - 1)
                plain = doc[at:to].tobytes() + (bounds[at : to + 1] - bounds[at]).tobytes() + variant[at:to].tobytes()
                yield {"block": [block], "docs": [zstandard.compress(plain, 1)], "text": [zstandard.compress(data[bounds[at] : bounds[to]].tobytes(), 6)]}
                block, at = block + 1, to

    return map_batches(docs, run, "block long, docs binary, text binary")


def block_fragments(docs: bytes, text: bytes, match: int) -> Fragments:
    plain = zstandard.decompress(docs)
    n = (len(plain) - 8) // 20
    own = np.frombuffer(plain, "i8", n), np.frombuffer(plain, "i8", n + 1, 8 * n), np.frombuffer(plain, "u4", n, 16 * n + 8)
    return fragments(np.frombuffer(zstandard.decompress(text), np.uint8), own[1], own[0], own[2], match)


def short_keys(key: np.ndarray, parts: int) -> np.ndarray:
    """28 bits of each key below the number of its part."""
    return key % np.uint64(parts) << np.uint64(32) | key // np.uint64(parts) & np.uint64(0xFFFFFFF)


def core_keys(blocks: DataFrame, match: int, parts: int) -> DataFrame:
    """Rows (part, block, keys): the distinct short keys of a block's cores, ascending."""

    def run(batches):
        for batch in batches:
            for block, docs, text in zip(batch.column("block").to_pylist(), batch.column("docs"), batch.column("text"), strict=True):
                keys = np.unique(short_keys(block_fragments(docs.as_py(), text.as_py(), match).key, parts))
                part = (keys >> np.uint64(32)).astype(np.int64)
                begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))[: len(part)])
                ends = np.append(begins[1:], len(part))
                low = keys.astype(np.uint32)
                yield {"part": part[begins], "block": [block] * len(begins), "keys": [packed_keys(low[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=False)]}

    return map_batches(blocks, run, "part long, block long, keys binary")


def shared_keys(rows: DataFrame, parts: int) -> DataFrame:
    """Of rows (part, block, keys), the keys that several blocks have; blocks without any have no row."""

    def closed(part, found):
        keys = np.concatenate([np.zeros(0, np.uint32), *(unpacked_keys(k) for _, k in found)])
        keys.sort()
        again = keys[1:][keys[1:] == keys[:-1]]  # a block sends a key once
        out = {"part": [], "block": [], "keys": []}
        for block, own in found:
            own = unpacked_keys(own)
            own = own[np.append(again, 0)[np.searchsorted(again, own)] == own] if len(again) else own[:0]
            if len(own):
                for c, x in zip(out, (part, block, packed_keys(own)), strict=True):
                    out[c].append(x)
        return out

    def run(batches):
        part, found = None, []
        for batch in batches:
            for p, block, keys in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "keys")), strict=True):
                if p != part:
                    yield closed(part, found)
                    part, found = p, []
                found.append((block, keys))
        yield closed(part, found)

    return map_batches(rows.repartition(parts, "part").sortWithinPartitions("part"), run, "part long, block long, keys binary")


def candidates(own: Fragments, shared: np.ndarray, parts: int) -> Fragments:
    """The fragments whose core is in several documents here, or among the short keys `shared` (ascending)."""
    order = np.argsort(own.key, kind="stable")  # and by doc
    key, doc = own.key[order], own.doc[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    ends = np.append(begins[1:], len(key))[: len(begins)]
    kept = doc[begins] < doc[ends - 1]
    if len(shared):
        short = short_keys(key[begins], parts)
        kept |= shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short
    return own.take(np.sort(order[np.repeat(kept, ends - begins)]))


def blobs(blocks: DataFrame, match: int, buckets: int, parts: int) -> DataFrame:
    """Rows (bucket, blob): fragments to compare, or spans that are removed already. blocks has the rows of blocks_of, written."""
    shared = shared_keys(core_keys(blocks, match, parts), parts)
    lists = shared.groupBy("block").agg(F.collect_list(F.struct("part", "keys")).alias("shared"))  # no more than the block's own keys
    both = blocks.join(lists, "block", "left")

    def run(batches):
        for batch in batches:
            for docs, text, lists in zip(batch.column("docs"), batch.column("text"), batch.column("shared").to_pylist(), strict=True):
                keys = [np.uint64(x["part"]) << np.uint64(32) | unpacked_keys(x["keys"]).astype(np.uint64) for x in lists or []]
                own = candidates(block_fragments(docs.as_py(), text.as_py(), match), np.sort(np.concatenate([np.zeros(0, np.uint64), *keys])), parts)
                sent, gone = local_repeats(own)
                rows = list(dealt(sent, buckets))
                if len(gone):
                    spans = merged(gone.doc, gone.variant, gone.pos, gone.pos + gone.size)
                    plain = b"".join(np.ascontiguousarray(x.astype(t)).tobytes() for x, t in zip(spans, ("i8", "u4", "i8", "i8"), strict=True))
                    rows.append((int(own.doc[0] * 31 + own.variant[0]) % buckets, b"R" + zstandard.compress(plain, 1)))
                yield {"bucket": [r[0] for r in rows], "blob": [r[1] for r in rows]}

    return map_batches(both, run, "bucket long, blob binary")


def compared(rows: DataFrame, match: int, core: int, buckets: int, limit: int) -> DataFrame:
    """doc, variant, begin and end of what is removed; and rows (bucket, blob) of buckets over `limit` bytes, for cores that are longer."""
    last = core >= match

    def run(batches):
        state = {"bucket": None, "blobs": [], "bytes": 0, "over": False}

        def spans(doc, variant, begin, end):
            n = len(doc)
            return {"doc": doc, "variant": variant.astype(np.int64), "begin": begin, "end": end, "bucket": [None] * n, "blob": [None] * n}

        def again(found):
            cut = list(dealt(finer(Fragments.joined(found), match, core), buckets))
            n = len(cut)
            return {"doc": [None] * n, "variant": [None] * n, "begin": [None] * n, "end": [None] * n, "bucket": [c[0] for c in cut], "blob": [c[1] for c in cut]}

        def closed():
            if state["blobs"]:
                yield again(state["blobs"]) if state["over"] else spans(*bucket_repeats(Fragments.joined(state["blobs"]), match))

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                blob = blob.as_py()
                if blob[:1] == b"R":
                    raw = zstandard.decompress(blob[1:])
                    n = len(raw) // 28
                    yield spans(np.frombuffer(raw, "i8", n), np.frombuffer(raw, "u4", n, 8 * n), np.frombuffer(raw, "i8", n, 12 * n), np.frombuffer(raw, "i8", n, 20 * n))
                    continue
                if bucket != state["bucket"]:
                    yield from closed()
                    state.update(bucket=bucket, blobs=[], bytes=0, over=False)
                state["blobs"].append(blob)
                state["bytes"] += zstandard.frame_content_size(blob[1:])
                if state["bytes"] > limit and not last:
                    yield again(state["blobs"])
                    state.update(blobs=[], bytes=limit, over=True)
        yield from closed()

    ordered = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return map_batches(ordered, run, "doc long, variant long, begin long, end long, bucket long, blob binary")


def repeated_spans(docs: DataFrame, match: int = MATCH, bucket_bytes: int = BUCKET, limit: int = LIMIT) -> DataFrame:
    """doc, variant, begin and end (bytes) of spans that are removed, several a document and overlapping; docs has doc, variant and text (bytes), and no null doc."""
    core = core_length(match)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-2 * total // bucket_bytes))  # fragments hold some 4.5 bytes for each byte of text, but not all are sent; up to `limit` a bucket is held
    parts = max(1, -(-2 * total // bucket_bytes))  # a core for each 14 bytes or so: some 600,000 keys
    path = scratch_path(docs.sparkSession, "blocks")
    one_by_one = {"parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}  # rows of a MB are not to gather by the hundred
    blocks = blocks_of(docs)
    blocks.write.options(compression="uncompressed", **one_by_one).parquet(path)
    rows, found = blobs(docs.sparkSession.read.schema(blocks.schema).parquet(path), match, buckets, parts), []
    while True:
        out = written(compared(rows, match, core, buckets, limit), "repeats", "zstd")
        if not found:
            deleted(docs.sparkSession, path)
        found.append(out.where("blob is null").select("doc", "variant", "begin", "end"))
        rows = out.where("blob is not null").select("bucket", "blob")
        if core >= match or rows.isEmpty():
            break
        core += -(-(match - core) // 2)
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    return spans


def remove_repeats(docs: DataFrame, match: int = MATCH, bucket_bytes: int = BUCKET, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay): a byte goes if a string of `match` bytes that covers it also starts in a document with a smaller doc_id.

    Null texts count as empty; texts shorter than `match` lose nothing. Strings that repeat
    in one document alone stay. Rows of one doc_id are judged each and do not
    remove from each other. A null doc_id is neither smaller nor larger than any:
    such a row loses nothing and takes nothing from others. Texts are bytes: a
    cut may fall inside a character. An empty table gives no rows. Other columns
    are ignored.
    """
    if match < 12 or 2 * match - core_length(match) > 255:
        raise ValueError("match must be from 12 to 169 bytes")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = docs.select("doc_id", F.col("doc_id").cast("long").alias("doc"), F.crc32(text).alias("variant"), text.alias("text"))
    spans = repeated_spans(whole.where("doc is not null").drop("doc_id"), match, bucket_bytes, limit)
    lists = spans.groupBy("doc", "variant").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # as many as a text has fragments
    both = whole.join(lists, ["doc", "variant"], "left").select("doc_id", "text", F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end"))

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            begins, ends = batch.column("begin"), batch.column("end")
            for i, text in enumerate(batch.column("text")):
                raw, kept, spans, at = text.as_buffer().to_pybytes(), [], 0, 0
                reach = -1
                if begins[i].is_valid:
                    for a, b in sorted(zip(begins[i].values.to_pylist(), ends[i].values.to_pylist(), strict=True)):
                        if a > reach:
                            kept.append(raw[at:a])
                            spans += 1
                        reach = at = max(reach, b)
                kept = b"".join([*kept, raw[at:]])
                for c, x in zip(out, (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[c].append(x)
            yield {"doc_id": batch.column("doc_id"), **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(both, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: The same rows from every 50-byte string, as hexadecimal digits.
SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, i, substr(h, 2 * i + 1, {2 * MATCH}) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - {MATCH - 1})) AS i FROM d)
), m AS (
  SELECT s, min(doc_id) AS low FROM s GROUP BY s
), g AS (
  SELECT s.doc_id, s.i, s.i - coalesce(lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i), -{MATCH + 1}) > {MATCH} AS new FROM s JOIN m ON s.s = m.s WHERE m.low < s.doc_id
), r AS (
  SELECT doc_id, k, min(i) AS a, max(i) + {MATCH} AS b FROM (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k
), p AS (
  SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM r
), q AS (
  SELECT doc_id, list(struct_pack(a := a, before := before) ORDER BY k) AS pieces, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(concat(array_to_string([substr(h, 2 * x.before + 1, 2 * (x.a - x.before)) FOR x IN coalesce(pieces, [])], ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN q ON d.doc_id = q.doc_id
"""
