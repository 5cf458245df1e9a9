"""Items of few words against brute force, with an edit at each place, and the recall of longer ones at the bound."""

import random

import numpy as np
import pytest

from basketry.llm import decontamination as d


def index(items):
    return d.Index([(i, " ".join(w).encode()) for i, w in enumerate(items)], d.SIMILARITY)


def ids_of(made, words):
    return np.array([made.vocabulary.get(w.encode(), -1) for w in words], np.int64)


def test_short_items_are_found_with_an_edit_at_any_place():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    items = [rng.sample(words, n) for n in (1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 12, 14, 15) for _ in range(3)]
    made, texts = index(items), []
    for item in items:
        for at in range(len(item)):
            for changed in (item[:at] + ["zz"] + item[at + 1 :], item[:at] + item[at + 1 :], item[:at] + ["zz"] + item[at:]):
                texts += [["x"] * 3 + changed + ["y"] * 3, changed]
    texts += [[rng.choice(words) for _ in range(200)] for _ in range(20)]
    ids = [ids_of(made, t) for t in texts]
    got = {(m[0], m[1]) for m in made.matches(ids)}
    want = {(t, i) for t, x in enumerate(ids) for i, item in enumerate(made.ids) if d.best_stretch(item.tolist(), x.tolist())[0] <= d.allowed_edits(len(item), d.SIMILARITY)}
    assert got == want and len(want) > 700


@pytest.mark.parametrize("kind", d.KINDS, ids="-".join)
def test_recall_of_longer_items_at_the_bound(kind):
    """Whole items of 16 to 4,000 words with all the edits that the bound allows, of one kind, inside other words."""
    rng, seeded = random.Random(6), np.random.default_rng(7)
    for length, n in ((16, 100), (23, 100), (31, 100), (40, 100), (60, 100), (100, 60), (200, 40), (1200, 10), (4000, 6)):
        items = [[f"w{rng.randrange(4000)}" for _ in range(length)] for _ in range(n)]
        made, texts = index(items), []
        for item in items:
            changed = d.edited(item, kind, d.allowed_edits(length, d.SIMILARITY), seeded)
            texts.append(["x"] * 5 + ["zz" if w == -2 else w for w in changed] + ["y"] * 5)
        found = {(m[0], m[1]) for m in made.matches([ids_of(made, t) for t in texts])}
        assert sum((k, k) in found for k in range(n)) >= d.RECALL * n, length


def test_a_similarity_that_walks_cannot_reach_is_an_error():
    with pytest.raises(ValueError, match="walks"):
        d.Index([(1, " ".join(f"w{i}" for i in range(16)).encode())], 0.0)
