"""Near copies against brute force over all pairs."""

import random

from basketry.llm import near_copies as n

from .near_copies_by_pairs import brute


def edited(rng, words, k):
    out = list(words)
    for at in rng.sample(range(len(out)), k):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def near_table(spark):
    rng = random.Random(4)
    make = lambda size: [f"w{rng.randrange(500)}" for _ in range(size)]
    texts = [" ".join(make(rng.randrange(1, 150))) for _ in range(60)]
    for size, k in ((100, 1), (200, 3), (300, 4), (60, 1)):
        base = make(size)
        texts += [" ".join(base), *[" ".join(edited(rng, base, k)) for _ in range(4)]]
    base = make(150)  # one dense bucket: its members are near each other in part only
    texts += [" ".join(edited(rng, base, rng.choice((0, 1, 2, 3)))) for _ in range(60)]
    texts += ["", None, " \n", "one two", "One  TWO"]
    rows = list(enumerate(texts))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_near_copies_are_those_of_all_pairs(spark):
    rows, frame = near_table(spark)
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in n.near_copies(frame).collect()} == want and len(set(want.values())) < len(rows) - 60


def test_dense_buckets_leave_no_pair_out(spark):
    rows, frame = near_table(spark)
    sketches = n._sketches(frame, 5)
    links = n.components(n.links_of(frame, sketches, 5, 0.8, bucket=2, chunk=7))
    low = {r["node"]: r["root"] for r in links.collect()}
    want, node = brute(rows), {r["doc_id"]: r["node"] for r in sketches.collect()}
    got = {i: low.get(node[i], node[i]) for i in node}
    assert len(set(got.values())) == len(set(want.values())) and all((got[a] == got[b]) == (want[a] == want[b]) for a in got for b in got)


def test_the_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline as c

    rows, frame = near_table(spark)
    assert {r["doc_id"] for r in c.near_dedup(spark, frame, "").collect()} == set(brute(rows).values())


def test_the_pipeline_stage_links_by_simhash_as_op6_does(spark):
    import corpus_pipeline as c
    from basketry.llm.simhash import near_duplicates

    rng = random.Random(9)
    make = lambda size: [f"w{rng.randrange(10**6)}" for _ in range(size)]
    phrase, other = make(41), make(200)  # an odd number of shingles: no bit is even
    texts = [" ".join(phrase * 60 + make(40)) for _ in range(3)]  # their sets of shingles differ, their fingerprints hardly
    edited_copy = edited(rng, other, 3)
    texts += [" ".join(other), " ".join(edited_copy), " ".join(make(200)), "", None]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    of_op6 = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame).collect()}
    assert [of_op6[i] for i in range(3)] == [0, 0, 0] and brute(rows)[1] == 1
    assert {r["doc_id"] for r in c.near_dedup(spark, frame, "").collect()} == {0, 3, 5, 6}
    links = {r["doc_id"]: r["component_id"] for r in n.near_copies(frame, simhash=True).collect()}
    assert links == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6}


def test_odd_tables(docs, no_docs):
    assert n.near_copies(docs).count() == docs.count() and n.near_copies(no_docs).count() == 0


def test_odd_tables_with_simhash(docs, no_docs):
    assert n.near_copies(docs, simhash=True).count() == docs.count() and n.near_copies(no_docs, simhash=True).count() == 0
