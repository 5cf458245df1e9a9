"""What the quality classifier sees of a text: shares and counts, each cut into bins."""

from __future__ import annotations

import zlib

import numpy as np

_WHITE = b" \t\n\v\f\r"
#: Edges of the bins of each measure.
SHARE = (0.0005, 0.003, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.8)
EDGES = {
    "words": (1, 3, 6, 10, 20, 40, 80, 160, 320, 640, 1280, 5000),
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 15, 25),
    "symbols": SHARE, "bars": SHARE, "bangs": SHARE, "digits": SHARE, "capitals": SHARE, "marks": SHARE, "others": SHARE,
    "distinct_words": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97),
    "top_word": (0.02, 0.04, 0.06, 0.08, 0.12, 0.2, 0.35, 0.6),
    "repeated_lines": SHARE, "repeated_spans": SHARE, "marked_words": SHARE, "upper_words": SHARE, "links": (0.0005, 0.003, 0.01, 0.03, 0.1),
    "line_words": (1, 2, 4, 8, 16, 32, 64, 128),
    "packed": (0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.65),
    "entropy": (2, 3, 3.5, 3.8, 4, 4.2, 4.4, 4.6, 5),
}
SLOTS = [(k, len(v) + 1) for k, v in EDGES.items()]
#: One place for each bin, and one that is always set.
WIDTH = 1 + sum(n for _, n in SLOTS)
_EDGES = [np.array(v, float) for v in EDGES.values()]
_KIND = np.zeros(256, np.uint8)
for _i, _chars in enumerate((_WHITE, b"#*$%&<>~^_=@+\\{}[]", b"|", b"!", b"0123456789", bytes(range(65, 91)), b".,;:?'\"()-", bytes(range(97, 123)), bytes(range(128, 256)))):
    _KIND[list(_chars)] = _i + 1


def measures(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), max(len(text), 1)
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[data], minlength=10)
    histogram = np.bincount(data, minlength=256)[1:]
    p = histogram[histogram > 0] / max(histogram.sum(), 1)
    letters = size - int(kinds[1])
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    spans = max(n - 4, 0)
    distinct = len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))) if spans else 0
    marked = sum(1 for w in counts if not w[-1:].isalnum() and len(w) > 3 and w[-1] == w[-2] and w[-1] < 128)
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    packed = len(zlib.compress(text, 1)) / size
    return [
        n, (letters / n) if n else 0, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[7] / size, kinds[0] / size,
        len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1), 1 - distinct / spans if spans else 0,
        marked / max(len(counts), 1), upper / max(n, 1), (text.count(b"http") + text.count(b"www.")) / max(n, 1), n / max(len(lines), 1), packed, float(-(p * np.log2(p)).sum()) if len(p) else 0,
    ]


def features(texts: list[bytes]) -> np.ndarray:
    """For each text, the place of the bin that is set for each measure (uint16)."""
    table = np.array([measures(t) for t in texts], float).reshape(len(texts), len(_EDGES))
    out, base = np.empty(table.shape, np.uint16), 1
    for i, edges in enumerate(_EDGES):
        out[:, i] = base + np.searchsorted(edges, table[:, i], side="right")
        base += len(edges) + 1
    return out
