import re

from basketry.llm import decontamination

from .near_copies_by_pairs import brute

D = "/root/testdata/sf0.001"


def test_stages_against_their_own_inputs(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = []
    for name, stage in c.STAGES:
        out = stage(spark, docs, D)
        seen.append((name, docs.collect(), out.collect()))
        if name != c.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(seen[-1][2], docs.schema)
    (_, a, b), (_, _, d), (_, _, e), (_, _, p), (_, _, last) = seen
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in b}
    assert kept <= {r["doc_id"] for r in a} and sum(labels[i] == (i in kept) for i in labels) / len(labels) > 0.95
    stay = set(brute([(r["doc_id"], r["text"]) for r in b]).values())  # one of each group of near copies: the smallest
    assert {r["doc_id"] for r in d} == stay
    items = [decontamination.fold(r["text"].encode()) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in d for i in items if set(i) & set(w := decontamination.fold(r["text"].encode())) and decontamination.best_stretch(i, w)[0] <= decontamination.allowed_edits(len(i), 0.8)}
    assert {r["doc_id"] for r in e} == stay - bad
    assert {r["doc_id"] for r in p} == {r["doc_id"] for r in e}
    before = {m for r in e for m in re.findall(r"\S+@\S+\.com|\d{3}-\d{4}|AKIA\w+", r["text"])}
    assert not before & {m for r in p for m in re.findall(r"\S+@\S+\.com|\d{3}-\d{4}|AKIA\w+", r["text"])}
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in p}


def test_stages_on_odd_and_empty_tables(spark, docs, no_docs):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        out = stage(spark, docs, D)
        assert stage(spark, no_docs, D).count() == 0
        if name != c.STAGES[-1][0]:
            assert out.columns == docs.columns and out.count() <= docs.count()
        else:
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


def test_stages_keep_columns_with_their_own_names(spark, docs):
    import corpus_pipeline as c

    names = ("n_entities", "_rejected", "_kept", "_found")
    more = docs
    for name in names:
        more = more.selectExpr("*", f"concat('{name}', coalesce(doc_id, 0)) as {name}")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, more, D)
        assert out.columns == more.columns, name
        assert sorted(r["doc_id"] or 0 for r in out.collect()) == sorted(r["doc_id"] or 0 for r in stage(spark, docs, D).collect()), name
        assert all(r[n] == f"{n}{r['doc_id'] or 0}" for r in out.select("doc_id", *names).collect() for n in names), name
