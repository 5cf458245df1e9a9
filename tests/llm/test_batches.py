"""The encoder's memory: batches of texts and the memo are bounded, and a full memo changes no ids."""

import numpy as np
import pyarrow as pa

from basketry.llm import pieces


def test_batches_hold_8_mb_and_all_texts():
    texts = pa.array([f"line {i} " + "a b c " * 40_000 for i in range(50)])
    sizes, at = [len(x.as_py()) for x in texts], 0
    for first, _, bounds in pieces.encoder(pieces.tokenizer_path())(texts):
        assert first == at and sum(sizes[at : at + len(bounds) - 1]) <= 1 << 23
        at += len(bounds) - 1
    assert at == len(texts)


def test_a_full_memo_gives_the_same_ids(monkeypatch):
    texts = pa.array(["the quick brown fox, 12 times", "", "ein übergroßer Text\n\nmit <|endoftext|> darin"] * 3)
    want = [ids for _, ids, _ in pieces.encoder(pieces.tokenizer_path())(texts)]
    pieces._memos.clear()
    monkeypatch.setattr(pieces, "MEMO_ENTRIES", 0)
    got = [ids for _, ids, _ in pieces.encoder(pieces.tokenizer_path())(texts)]
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
