import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import packing, pieces, token_ids


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pieces.tokenizer_path())


def plain(text):
    return library().encode(text, add_special_tokens=False).ids


def ids_of(texts):
    out = []
    for _, ids, bounds in pieces.encoder(pieces.tokenizer_path())(pa.array(texts, pa.string())):
        cut = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
        assert all(x[-1] == 0 for x in cut)
        out += [x[:-1] for x in cut]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60000) | st.just(0), max_size=400))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, offsets = token_ids.simple8b_encode(a)
    assert (token_ids.simple8b_decode(words, offsets, len(a)) == a).all()


def test_simple8b_over_several_blocks():
    a = np.random.default_rng(0).integers(0, 50000, 3 * token_ids.BLOCK + 5, dtype=np.uint64)
    words, offsets = token_ids.simple8b_encode(a)
    assert len(offsets) == 4 and len(words) < len(a) // 2
    assert (token_ids.simple8b_decode(words, offsets, len(a)) == a).all()


@pytest.mark.parametrize("text", ["it's  a\t\tb\n\n c", "½² ''s I'll\r\n", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x <|endoftext", "word?!) (word), it's.", "", "   ", "日本語 x" * 3, "\x85 a\x1cb c"])
def test_memo_gives_the_ids_of_the_library(text):
    assert ids_of([text, "", text]) == [plain(text), [], plain(text)]


def test_special_tokens_in_a_text_are_those_of_the_library():
    assert ids_of(["a<|endoftext|>b"]) == [plain("a<|endoftext|>b")] == [[64, 50256, 65]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZé 1½ß日'st.,!\n\t\x85\x1c\xa0\u3000\u2003😀²", "<|endoftext|>", "  ", "'s"]) | st.characters(codec="utf-8"), max_size=12).map("".join), max_size=6))
def test_any_texts_have_the_ids_of_the_library(texts):
    assert ids_of(texts) == [plain(t) for t in texts]


def test_batches_end_between_texts(monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_BYTES", 10)
    texts = ["one two three four", "", "a b", "", "cdefg hi", " "]
    assert ids_of(texts) == [plain(t) for t in texts]

def test_files_hold_the_ids_in_order(spark, docs, tmp_path):
    path = str(tmp_path / "ids")
    token_ids.write_token_ids(docs, path)
    got = token_ids.read_token_ids(spark, path, with_ids=True).orderBy("start").collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    start = 0
    for r, (_, text) in zip(got, rows, strict=True):
        ids = [*plain(text or ""), 0]
        assert r["ids"] == ids and r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_file_set(spark, no_docs, tmp_path):
    token_ids.write_token_ids(no_docs, str(tmp_path / "none"))
    assert token_ids.read_token_ids(spark, str(tmp_path / "none")).count() == 0


def test_best_fit_and_the_fullest_closes():
    bins = packing.OpenSequences(10, 2)
    assert [bins.place(n) for n in (4, 7, 3, 10, 6)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 4)]
    bins = packing.OpenSequences(10, 1)
    assert [bins.place(n) for n in (4, 7, 3, 6)] == [(0, 0), (1, 0), (1, 7), (2, 0)]


def test_packing_covers_every_token_once(docs, no_docs):
    got = packing.pack_documents(docs, sequence=64, with_ids=True)
    rows = got.collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert sum(r["length"] for r in rows) == sum(len(plain(t or "")) + 1 for (t,) in docs.select("text").collect())
    long = sorted((r for r in rows if r["doc_id"] == 44), key=lambda r: r["piece"])
    assert all(r["length"] == 64 for r in long[1:]) and b"".join(bytes(r["ids"]) for r in long) == np.array([*plain(docs.where("doc_id = 44").first()["text"]), 0], "<u4").tobytes()
    assert packing.sequences(got).count() == len(by_sequence)
    assert packing.pack_documents(no_docs).count() == 0
