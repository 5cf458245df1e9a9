import zlib

from basketry.llm import sharding


def test_shards_are_even_and_slots_gapless(docs, no_docs):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count()
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1 and all(s == list(range(len(s))) for s in sizes)
    texts = {r["doc_id"]: (r["text"] or "") for r in docs.collect() if r["doc_id"] not in (None, 7)}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows if r["doc_id"] in texts)
    assert sharding.shard_documents(no_docs).count() == 0


def test_overflow_goes_clockwise_to_the_next_shard_with_room():
    pieces = sharding.fill([5, 1, 0], [0, 1, 2], [2, 2, 2])
    assert pieces == [(0, 0, 2, 0, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 0), (1, 0, 1, 2, 1)]


def test_more_shards_only_add_nodes():
    assert set(sharding.ring(8)) <= set(sharding.ring(9))
