import hashlib
import random

import numpy as np
import pytest

from basketry.llm import repeats


def brute(rows, match):
    """rows (doc_id, text) -> for each (n_bytes, n_removed, n_spans, sha256)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for at in range(len(t) - match + 1):
                s = t[at : at + match]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for at in range(len(t) - match + 1):
                if least[t[at : at + match]] < i:
                    gone[at : at + match] = b"\1" * match
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(frame, match, **more):
    rows = repeats.remove_repeats(frame, match, **more).collect()
    for r in rows:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=str)


def corpus(seed, match):
    rng = random.Random(seed)
    letters = "ab \nü"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (match - 1, match, match + 1, 3 * match, 10 * match)] + ["a" * 4 * match, "ab" * 2 * match]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(2 * match))) for _ in range(rng.randrange(1, 6))]
        rows.append((i * 7 % 60, "".join(parts)))
    rows += [(100, None), (101, ""), (None, shared[4]), (None, None), (5, rows[3][1]), (5, shared[4]), (102, rows[9][1]), (-4, rows[9][1]), (103, rows[9][1] + "x")]
    return rows


@pytest.mark.parametrize(("match", "seed"), [(12, 1), (20, 2), (50, 3)])
def test_against_all_strings(spark, match, seed):
    rows = corpus(seed, match)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(brute(rows, match), key=str)
    assert got(frame, match) == want
    assert got(frame, match, bucket_bytes=2000) == want


def test_hot_buckets_are_dealt_again_by_longer_cores(spark):
    rows = corpus(4, 20)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(frame, 20, bucket_bytes=1 << 14, limit=600) == sorted(brute(rows, 20), key=str)


def test_odd_tables(spark, docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(docs, 50) == sorted(brute(rows, 50), key=str)
    assert repeats.remove_repeats(no_docs).count() == 0


def test_suffixes_and_borders_are_those_of_the_definition():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(14, 22))) for _ in range(40)]
    texts += [texts[0][:14], texts[1][2:]]
    width = 22
    matrix = np.array([list(t.ljust(width, b"\0")) for t in texts], np.uint8)
    sizes = np.array([len(t) for t in texts])
    docs = np.array([rng.randrange(9) for _ in texts])
    out = repeats.smallest_docs(matrix, sizes, docs, 14)
    for i, t in enumerate(texts):
        for at in range(width - 14 + 1):
            s = t[at : at + 14]
            if len(s) < 14:
                assert out[i, at] == np.iinfo(np.int64).max
            else:
                assert out[i, at] == min(d for u, d in zip(texts, docs, strict=True) if s in u)


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(repeats, "CHUNK", 200)
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, text[1000:1900]), (2, text), (3, text[4000:] + text[:700]), (4, "z" * 500), (5, "z" * 900)]
    data = [t.encode() for _, t in rows]
    own = repeats.fragments(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), np.array([i for i, _ in rows]), np.zeros(5, np.uint32), 50)
    sent, gone = repeats.local_repeats(own)
    spans = repeats.bucket_repeats(sent, 50)
    both = [np.concatenate((a, b)) for a, b in zip(spans, (gone.doc, gone.variant, gone.pos, gone.pos + gone.size), strict=True)]
    removed = {}
    for d, _, a, b in zip(*repeats.merged(*both), strict=True):
        removed.setdefault(int(d), []).append((int(a), int(b)))
    for i, n_bytes, n_removed, n_spans, _ in brute(rows, 50):
        assert sum(b - a for a, b in removed.get(i, [])) == n_removed and len(removed.get(i, [])) == n_spans, (i, n_bytes)


def test_keys_and_columns_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 28, n)).astype(np.uint32)
        assert np.array_equal(repeats.unpacked_keys(repeats.packed_keys(keys)), keys)
        wide = rng.integers(-(1 << 60), 1 << 60, n)
        assert np.array_equal(repeats.from_planes(b"xx" + repeats.planes(wide), "i8", n, 2), wide)


def test_equal_rows_by_bytes_when_hashes_are_equal(monkeypatch):
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 2, (300, 9), dtype=np.uint8)
    rows[:, -1] = 9
    for step in (repeats._STEP, np.zeros(60, np.uint64)):  # zeros: all hashes are equal
        monkeypatch.setattr(repeats, "_STEP", step)
        lead, of = repeats.equal_rows(rows)
        assert np.array_equal(rows[lead[of]], rows) and len(np.unique(rows, axis=0)) == len(lead)


def test_candidates_are_cores_of_several_documents_or_shared_ones():
    same, alone = b"the same passage in two documents of one block, word for word. ", bytes(range(97, 123)) * 3
    data = [same, same, alone]
    own = repeats.fragments(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), np.array([1, 2, 3]), np.zeros(3, np.uint32), 50)
    assert set(repeats.candidates(own, np.zeros(0, np.uint64), 7).doc.tolist()) == {1, 2}
    other = np.unique(repeats.short_keys(own.key[own.doc == 3], 7))
    assert set(repeats.candidates(own, other, 7).doc.tolist()) == {1, 2, 3}
