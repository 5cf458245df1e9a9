import random

from xxhash import xxh64_intdigest

from basketry.llm import components, simhash


def brute(text):
    words = text.lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    low = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 2 and low[b] < low[a]:
                    low[a], changed = low[b], True
    return low


def test_fingerprint_is_that_of_the_definition():
    for text in (b"", b" ", b"One", b"a b c", b"a b c d", b"A B  c\td e a b c d e" * 7):
        assert simhash.fingerprint(text) == brute(text)


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = set(base)
    for b in base[:6]:  # clusters, two of them dense enough for the second way
        near = b
        for _ in range(90 if b in base[:2] else 12):
            near = rng.choice([b, near]) ^ 1 << rng.randrange(8 if b in base[:2] else 64)
            values.add(near)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=8)
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = roots(signed)
    assert {v: got.get(v, v) for v in signed} == want


def test_near_duplicates(docs, no_docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[45]["component_id"] == by_id[46]["component_id"] == by_id[3]["component_id"] == 3
    assert by_id[40]["fingerprint"] == "0" * 16 and by_id[41]["component_id"] == by_id[42]["component_id"] == 40
    assert simhash.near_duplicates(no_docs).count() == 0
