"""Token ids of texts by a byte-level BPE file of the tokenizers library.

A batch of texts is cut at borders that merges never cross, all texts at once;
Arrow numbers the distinct units, and only those go through the memo and, where
it lacks them, through the library's BPE model. The ids of the units are then
laid out in the order of the texts.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-tokens of a text, as the published byte-level pattern has them.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII. Texts with such characters are cut by the pattern itself.
WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
MEMO_ENTRIES, MEMO_BYTES, BATCH_BYTES = 400_000, 64, 1 << 23
_SPACE, _WORD, _MARK = (np.zeros(256, bool) for _ in range(3))
_SPACE[[*range(9, 14), 32]] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[[c for c in range(33, 127) if not _WORD[c]]] = True


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """Text -> its ids as little-endian unsigned 32-bit bytes. It takes no more when it is full; what it lacks is encoded each time."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.model, self.split = tokenizer.model, regex.compile(PIECE).findall
        # bytes that are not printable stand for code points from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.chars = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.after_space = chr(self.chars[32])
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in their surroundings are not supported")
        #: Tokens that a text may hold as they are; they are found before anything else.
        self.whole = {t.content: i.to_bytes(4, "little") for i, t in added.items()}
        longest_first = sorted(self.whole, key=len, reverse=True)
        self.at_whole = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def _piece(self, piece: bytes) -> bytes:
        if piece.isalnum():
            mapped = piece.decode()
        elif piece[1:].isalnum() and piece[:1] == b" ":
            mapped = self.after_space + piece[1:].decode()
        else:
            mapped = piece.decode("latin-1").translate(self.chars)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def _plain(self, text: str) -> bytes:
        parts = self.split(text)
        if len(parts) == 1:
            return self._piece(text.encode())
        return b"".join([self[p.encode()] for p in parts])

    def __missing__(self, unit: bytes) -> bytes:
        if (unit[1:] if unit[:1] == b" " else unit).isalpha():  # ASCII letters alone are one piece
            ids = self._piece(unit)
        else:
            text = unit.decode()
            if any(content in text for content in self.whole):
                ids = b"".join([self.whole[x] if i % 2 else self._plain(x) for i, x in enumerate(self.at_whole.split(text)) if x])
            else:
                ids = self._plain(text) if text else b""
        if len(unit) <= MEMO_BYTES and len(self) < MEMO_ENTRIES:
            self[unit] = ids
        return ids


def _borders(data: np.ndarray, bounds: np.ndarray, uncut: np.ndarray) -> np.ndarray:
    """Where units begin, in texts that stand one after the other; texts that are `uncut` are a unit each.

    A run of white space begins a unit, and so does its last character if a word
    follows; that one goes with the word if it is a space. Marks after ASCII
    letters and digits begin a unit too.
    """
    space = _SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    inner, before = begins[1:-1], space[:-1]
    word_next = np.append(~space[1:], False)
    word_next[bounds[1:][bounds[1:] > 0] - 1] = False  # nothing follows at the end of a text
    np.copyto(inner, space[1:] & (~before | word_next[1:]))
    inner |= ~space[1:] & before & (data[:-1] != 32)
    inner |= _MARK[data[1:]] & _WORD[data[:-1]]
    for i in np.flatnonzero(uncut).tolist():
        begins[bounds[i] : bounds[i + 1]] = False
    begins[bounds] = True
    begins[-1] = False
    return np.flatnonzero(begins)


def _encoded(memo: _Memo, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(data):
        return np.full(len(texts), end, np.uint32), np.arange(len(texts) + 1)
    odd = pc.match_substring_regex(texts, WIDE_SPACE)
    for content in memo.whole:
        odd = pc.or_(odd, pc.match_substring(texts, content))
    begins = _borders(data, bounds, odd.to_numpy(zero_copy_only=False))
    offsets = np.append(begins, len(data)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    ids = pa.array(list(map(memo.__getitem__, units.dictionary.to_pylist())), pa.large_binary()).take(units.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(begins) + 1] // 4
    first = ends[np.searchsorted(begins, bounds)]  # a text's first unit; an empty one has none
    flat = np.insert(np.frombuffer(ids.buffers()[2], np.uint32)[: ends[-1]], first[1:], end)
    return flat, first + np.arange(len(first))


def encoder(path: str, end: int = 0):
    """A function from an Arrow array of texts without nulls to batches of (ids, bounds): text i has ids[bounds[i] : bounds[i + 1]], `end` last.

    One memo for each Python worker, which tasks share. Batches hold texts of BATCH_BYTES or one text.
    """
    memos = sys.modules[__name__].__dict__.setdefault("_memos", {})
    memo = memos.get(path)
    if memo is None:
        memos.clear()
        memo = memos[path] = _Memo(path)

    def encode(texts: pa.Array):
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + BATCH_BYTES, side="right")))
            yield at, *_encoded(memo, texts.slice(at, to - at), end)
            at = to

    return encode
