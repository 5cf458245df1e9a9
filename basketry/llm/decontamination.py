"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts are sequences of words. The CGK random walk reads a sequence with a
pointer: at step t it writes the word under the pointer, then moves on or stays
as a random function of (t, word) says. Two sequences that are a few edits apart
meet again after each edit, so their embeddings agree at most steps: edit
distance has become Hamming distance. Sampling a few steps of an embedding and
comparing what is written there is locality-sensitive hashing for it; independent
walks with SAMPLES samplings each are the tables.

Items are cut into segments of SHORT to 2 * SHORT - 1 words. If an item is within
its bound, one of its segments at least is within its own share of the edits, so
the segments are what is embedded, at any length of the item. A segment is read
forwards from its first word and backwards from its last: a block of edits at one
end, which shifts all that follows, is behind the other reading. For each class of
lengths, walks are added until random segments with as many edits as their bound
allows (spread deletions, insertions, replacements, mixtures, and blocks deleted,
put in or replaced in front, middle and end: KINDS, each on its own) meet their
originals at a rate above RECALL in the worst kind, half of what is over it as a
margin (tests/llm/test_short_items.py measures it on other items).

Items of fewer than SHORT words have too few steps for that and are looked up
exactly: cut into one piece more than the edits allowed, an item leaves at least one
piece whole in every match, so all places of all pieces are looked at.

Windows of the segments begin at every word. Before they are embedded, the q-gram lemma leaves
out those which cannot match: a passage within k edits of a segment of n words has
at least n - 2 - 3k of its word triples (one at least where that is less, by the
pigeonhole rule).

Each (document, item) that meets in a table is verified by the exact edit distance of
the whole item to the best stretch of the document there. The result has no false match.

The benchmark is a query set: it goes to the tasks in blocks of about
BLOCK_ITEMS items and BLOCK_BYTES bytes at most, each block read against all
documents. A worker builds the tables of a block once, for all of its tasks.
"""

from __future__ import annotations

import sys
import uuid
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_columns, table, text_bytes

SIMILARITY, SAMPLES, STEPS_SAMPLED, CLASS, BLOCK_ITEMS, BLOCK_BYTES, RECALL, SHORT = 0.8, 6, 2, 8, 20_000, 1 << 25, 0.95, 16
#: WALKS_IN_VAIN: a similarity that needs more walks than this is an error, not a loss.
WORDS_AT_ONCE, TRIALS, WALKS_IN_VAIN = 1 << 20, 300, 512
#: What edits replace a word by, and where they are; each is held to RECALL on its own.
EDITS, PLACES = ("delete", "insert", "replace", "any"), ("spread", "front", "middle", "end")
KINDS = [(e, p) for e in EDITS for p in PLACES if (e, p) != ("any", "front")]
#: Words have no case and no ASCII punctuation.
FOLD = bytes(32 if (33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126) else c + 32 if 65 <= c <= 90 else c for c in range(256))


def fold(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def allowed_edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def embed(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """CGK embeddings (steps x windows) of the windows of `ids` that begin at `starts`; at and after `ends` they read what stands there, -1."""
    out = np.empty((steps, len(starts)), np.int64)
    at = starts.copy()
    for t in range(steps):
        out[t] = ids[np.minimum(at, ends)]
        key = out[t].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((walk * 1_000_003 + t + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        at += (_mix(key) >> np.uint64(63)).astype(np.int64)
    return out


def best_stretch(item: list, text: list) -> tuple[int, int]:
    """(edit distance, end) of the stretch of text that is nearest to the item, by Myers' bit vectors."""
    n = len(item)
    peq: dict = {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = full, 0, n, n, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _laid_out(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items one after the other with a -1 after each, where they begin, and where the -1s are."""
    lengths = np.array([len(x) for x in items], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    flat = np.full(int(lengths.sum()) + len(items), -1, np.int64)
    body = np.ones(len(flat), bool)
    body[ends] = False
    flat[body] = np.concatenate(items)
    return flat, ends - lengths, ends


def steps_of(length_class: int) -> int:
    return int(1.5 * length_class * CLASS)


def samplings(length_class: int, seed: int):
    """For each walk, the steps that its tables compare."""
    rng, steps = np.random.default_rng([seed, length_class]), steps_of(length_class)
    while True:
        yield [np.sort(rng.choice(steps, min(STEPS_SAMPLED, steps), replace=False)) for _ in range(SAMPLES)]


def edited(item: list, kind: tuple[str, str], edits: int, rng) -> list:
    """item after so many edits of one kind; new words are -2."""
    edit, place = kind
    n = len(item)
    begin = {"front": 0, "middle": (n - edits) // 2, "end": n - edits}.get(place)
    places = range(begin, begin + edits) if begin is not None else sorted(rng.choice(n, edits, replace=False).tolist())
    out = list(item)
    for at in reversed(places):
        how = EDITS[rng.integers(3)] if edit == "any" else edit
        out[at : at + 1] = {"delete": [], "insert": [-2, item[at]], "replace": [-2]}[how]
    return out


@cache
def walks_needed(length_class: int, similarity: float, seed: int) -> int:
    """Walks after which random segments of the class with the most edits allowed met their originals often enough, forwards or backwards, in the worst of KINDS."""
    rng, originals, changed = np.random.default_rng([seed, length_class, 1]), [], []
    for kind in KINDS:
        for i in range(TRIALS):
            n = length_class * CLASS + (CLASS - 1) * (i % 2)
            item = rng.integers(0, 1 << 20, n)
            originals.append(item)
            changed.append(np.array(edited(item.tolist(), kind, allowed_edits(n, similarity), rng), np.int64))
    met = np.zeros(len(originals), bool)
    sides = [(_laid_out(originals), _laid_out(changed)), (_laid_out([x[::-1] for x in originals]), _laid_out([x[::-1] for x in changed]))]
    for walk, picks in zip(range(WALKS_IN_VAIN), samplings(length_class, seed), strict=False):
        for a, b in sides:
            x, y = (embed(*side, steps_of(length_class), walk) for side in (a, b))
            for pick in picks:
                met |= (x[pick] == y[pick]).all(axis=0)
        if met.reshape(len(KINDS), TRIALS).mean(axis=1).min() >= (1 + RECALL) / 2:
            return walk + 1
    raise ValueError(f"{WALKS_IN_VAIN} walks do not reach a recall of {RECALL} at similarity {similarity}")


def run_codes(ids: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of q known words, -1 where a word is unknown."""
    n = len(ids) - q + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(q):
        part = ids[j : j + n]
        known &= part >= 0
        out = _mix(out * np.uint64(31) + part.astype(np.uint64) + np.uint64(1))
    return np.where(known, (out >> np.uint64(1)).astype(np.int64), -1)


def segments(n: int) -> list[tuple[int, int]]:
    """Bounds of the segments of an item of n words, SHORT or more."""
    parts = n // SHORT
    return [(i * n // parts, (i + 1) * n // parts) for i in range(parts)]


class Reading:
    """The LSH tables of segments in one direction."""

    def __init__(self, parts: list[np.ndarray], similarity: float, seed: int):
        self.lengths = np.array([len(x) for x in parts], np.int64)
        self.longest = int(self.lengths.max(initial=0))
        self.reach = self.longest + allowed_edits(self.longest, similarity)
        runs: dict[int, list] = {}
        self.need: dict[int, int] = {}
        for x in parts:
            n, k = len(x), allowed_edits(len(x), similarity)
            q = min(3, -(-(n - k) // (k + 1)))
            need = max(1, n - q + 1 - q * k)
            runs.setdefault(q, []).append(run_codes(x, q))
            self.need[q] = min(self.need.get(q, need), need)
        self.runs = {q: np.unique(np.concatenate(r)) for q, r in runs.items()}
        self.classes: list[tuple[int, list]] = []
        for c in np.unique(self.lengths // CLASS).tolist():
            mine = np.flatnonzero(self.lengths // CLASS == c)
            laid_out, tables = _laid_out([parts[k] for k in mine]), []
            for walk, picks in zip(range(walks_needed(c, similarity, seed)), samplings(c, seed), strict=False):
                embedded = embed(*laid_out, steps_of(c), walk)
                for pick in picks:
                    keys = self.key(embedded, pick)
                    order = np.argsort(keys, kind="stable")
                    tables.append((walk, pick, keys[order], mine[order]))
            self.classes.append((steps_of(c), tables))

    @staticmethod
    def key(embedded: np.ndarray, pick: np.ndarray) -> np.ndarray:
        out = np.zeros(embedded.shape[1], np.uint64)
        for t in pick:
            out = _mix(out * np.uint64(31) + embedded[t].astype(np.uint64) + np.uint64(7))
        return out

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold enough runs of a segment's words."""
        first = np.arange(len(ids))
        use = np.zeros(len(ids), bool)
        for q, runs in self.runs.items():
            codes = run_codes(ids, q)
            at = np.minimum(np.searchsorted(runs, codes), len(runs) - 1)
            hit = np.concatenate(([0], np.cumsum(runs[at] == codes)))
            # a match may begin some words before or after the window of its segment, so windows reach further
            hits = hit[np.minimum(first + self.reach, len(hit) - 1)] - hit[np.minimum(first, len(hit) - 1)]
            use |= hits >= self.need[q]
        return np.flatnonzero(use)

    def met(self, ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """(start, index of a segment) of the windows that meet it in a table."""
        starts = self.windows(ids)
        longest = max((s for s, _ in self.classes), default=0)
        walks = max((t[-1][0] + 1 for _, t in self.classes), default=0)
        found = []
        for a in range(0, len(starts), 1 << 16):  # bounds the memory
            some = starts[a : a + (1 << 16)]
            own_end = ends[np.searchsorted(ends, some)]
            mine = []
            for walk in range(walks):
                embedded = embed(ids, some, own_end, longest, walk)
                for _, tables in self.classes:
                    for _, pick, keys, parts in (t for t in tables if t[0] == walk):
                        own = self.key(embedded, pick)
                        lo = np.searchsorted(keys, own)
                        met = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == own)
                        if len(met):
                            n = np.searchsorted(keys, own[met], side="right") - lo[met]
                            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                            mine.append(np.stack([np.repeat(some[met], n), parts[np.repeat(lo[met], n) + offset]], axis=1))
            if mine:
                found.append(np.unique(np.concatenate(mine), axis=0))
        return found


class Index:
    """The LSH tables of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float, seed: int = 11):
        self.similarity = similarity
        folded = [(i, fold(t)) for i, t in items]
        self.items = [(i, w) for i, w in folded if w]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        self.pieces = self.cut([k for k, x in enumerate(self.ids) if len(x) < SHORT])
        cuts = [(k, a, b) for k, x in enumerate(self.ids) if len(x) >= SHORT for a, b in segments(len(x))]
        self.segment_item, self.segment_start = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))
        parts = [self.ids[k][a:b] for k, a, b in cuts]
        self.forwards, self.backwards = Reading(parts, similarity, seed), Reading([x[::-1] for x in parts], similarity, seed)

    def cut(self, short: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By the length of a piece: codes of the pieces of these items in order, indices of the items, places of the pieces in them."""
        held: dict[int, list] = {}
        for k in short:
            n, parts = len(self.ids[k]), allowed_edits(len(self.ids[k]), self.similarity) + 1
            bounds = [i * n // parts for i in range(parts + 1)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a < b:
                    held.setdefault(b - a, []).append((int(run_codes(self.ids[k][a:b], b - a)[0]), k, a))
        return {q: tuple(np.array(column, np.int64) for column in zip(*sorted(rows), strict=True)) for q, rows in held.items()}

    def short_candidates(self, ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """(start, index of an item) of each place of a piece of a short item."""
        found = []
        for q, (keys, items, offsets) in self.pieces.items():
            own = run_codes(ids, q)
            lo = np.searchsorted(keys, own)
            met = np.flatnonzero((own >= 0) & (keys[np.minimum(lo, len(keys) - 1)] == own))
            if len(met):
                n = np.searchsorted(keys, own[met], side="right") - lo[met]
                at = np.repeat(lo[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text = np.searchsorted(ends, met)
                first = np.where(text > 0, ends[np.maximum(text - 1, 0)] + 1, 0)
                found.append(np.stack([np.maximum(np.repeat(met, n) - offsets[at], np.repeat(first, n)), items[at]], axis=1))
        return found

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(start, index of an item) of the places of short items' pieces, and of where an item would begin whose segment meets a window in a table. ids: texts with a -1 after each, at `ends`."""
        found = self.short_candidates(ids, ends)
        turned, turned_ends = np.append(ids[-2::-1], -1), np.append(len(ids) - 2 - ends[-2::-1], len(ids) - 1)
        for met in self.forwards.met(ids, ends):
            found.append(self.placed(met[:, 0], met[:, 0], met[:, 1], ends))
        for met in self.backwards.met(turned, turned_ends):
            last = np.maximum(len(ids) - 2 - met[:, 0], 0)
            found.append(self.placed(last - self.backwards.lengths[met[:, 1]] + 1, last, met[:, 1], ends))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def placed(self, begin: np.ndarray, seen: np.ndarray, parts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(start, item) of segments that begin about `begin`, in the texts that `seen` is in."""
        text = np.searchsorted(ends, seen)
        first = np.where(text > 0, ends[np.maximum(text - 1, 0)] + 1, 0)
        return np.stack([np.maximum(begin - self.segment_start[parts], first), self.segment_item[parts]], axis=1)

    def matches(self, texts: list[np.ndarray]):
        """(index of a text, item_id, first word, words, edits, similarity) of each item that a text has, at its best stretch."""
        ids = np.concatenate([x for t in texts for x in (t, [-1])]) if texts else np.empty(0, np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        found: dict[tuple[int, int], list[int]] = {}
        for start, k in self.candidates(ids, ends).tolist() if len(ids) else ():
            d = int(np.searchsorted(ends, start))
            found.setdefault((d, k), []).append(start - (int(ends[d - 1]) + 1 if d else 0))
        for (d, k), starts in found.items():
            item, text = self.ids[k].tolist(), texts[d]
            n, bound = len(item), allowed_edits(len(item), self.similarity)
            best, a = None, 0
            while a < len(starts):  # starts near each other share a stretch
                b = a
                while b + 1 < len(starts) and starts[b + 1] - starts[b] <= n:
                    b += 1
                lo, hi = max(0, starts[a] - 2 * bound - 1), starts[b] + n + 2 * bound + 1
                stretch = text[lo:hi].tolist()
                edits, end = best_stretch(item, stretch)
                if edits <= bound and (best is None or edits < best[2]):
                    _, length = best_stretch(item[::-1], stretch[:end][::-1])
                    best = (lo + end - length, length, edits)
                a = b + 1
            if best is not None:
                yield d, self.items[k][0], *best, 1 - best[2] / n


def _index(name: str, items: list, similarity: float) -> Index:
    """The index of a block, built once in a Python worker."""
    held = sys.modules[__name__].__dict__.setdefault("_indices", {})
    if (name, similarity) not in held:
        held.clear()
        held[name, similarity] = Index(items, similarity)
    return held[name, similarity]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits and similarity of each benchmark item that a document has, at its best place.

    Words are compared without case and ASCII punctuation; similarity is 1 minus
    word edits over the item's words. Null and empty texts match nothing, as do
    benchmark rows without words; null ids are returned as they are, and repeated rows
    match each. Other columns are ignored. Empty tables give no rows.
    """
    items = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    schema = "doc_id long, item_id long, first_word long, n_words long, edits int, similarity double"
    names = [c.split()[0] for c in schema.split(", ")]
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = docs.sparkSession.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in block.collect()])

        def run(batches, index=index, name=uuid.uuid4().hex):
            made = _index(name, index.value, similarity)
            known = type("Known", (dict,), {"__missing__": lambda self, w: -1})(made.vocabulary).__getitem__

            def rows(held):
                found = [(held[m[0]][0], *m[1:]) for m in made.matches([x for _, x in held])] if made.ids else []
                if found:
                    yield dict(zip(names, map(list, zip(*found, strict=True)), strict=True))

            for batch in batches:
                held, words = [], 0
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                    held.append((doc_id, np.fromiter(map(known, fold(text)), np.int64)))
                    words += len(held[-1][1])
                    if words >= WORDS_AT_ONCE:
                        yield from rows(held)
                        held, words = [], 0
                yield from rows(held)

        part = map_columns(text_bytes(docs), run, schema)
        found = part if found is None else found.union(part)
    return found


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
