import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.llm import language_model, quality_classifier, quality_rules
from basketry.llm.common import crc_of_id

D = "/root/testdata/sf0.001"


def test_language_model_against_brute_force(docs, no_docs):
    got = language_model.score_documents(docs, crc_of_id() % 7 != 2).collect()
    assert len(got) == docs.count()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter()
    for r in docs.collect():
        if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 != 2:
            c.update(tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in (None, 7)}
    for r in got:
        if r["doc_id"] in texts:
            t = tokens(texts[r["doc_id"]])
            assert r["n_tokens"] == len(t) and r["n_known"] == sum(c[w] > 0 for w in t) and r["train_tokens"] == n
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
            assert r["score"] < 0
    assert language_model.score_documents(no_docs, F.lit(True)).count() == 0


def test_em_finds_the_weights_of_a_mixture():
    s = language_model.STEP
    rows = [(3, -2 * s, -8 * s, 700.0), (3, language_model.LOWEST * s, -8 * s, 300.0)]
    w = language_model.expectation_maximisation(rows, 2.0**-20)[3]
    assert w.sum() == pytest.approx(1) and 0.65 < w[0] < 0.75


def test_model_beats_unigrams_on_held_out_documents(spark):
    d = spark.read.parquet(f"{D}/documents.parquet")
    r = language_model.score_documents(d, crc_of_id() % 7 != 2).where(crc_of_id() % 7 == 2).agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_repeated_words_count_the_first_window_too():
    words = [str(i).encode() for i in range(20)]
    assert quality_rules.repeated_words(words) == 0
    assert quality_rules.repeated_words(words[:8] + [b"x"] + words[:8]) == 16
    assert quality_rules.repeated_words([b"a"] * 9) == 9


def test_line_rules():
    v = lambda s: quality_rules.line_verdict(s, s.encode().split())
    assert v("A line of plain words, with an end.") == "" and v("  ") == "empty"
    assert v("Home | News | About | Contact") == "navigation" and v("All rights reserved.") == "boilerplate"
    assert v("THE!! NEWS!! OF!! THE!! DAY!!") == "capitals" and v("wo### rd$$$ of*** no&&& sense%%%") == "symbols"


def test_clean_documents(docs, no_docs):
    got = {r["doc_id"]: r for r in quality_rules.clean_documents(docs).collect()}
    assert got[40]["n_words"] == 0 and got[40]["base_failed"] and not got[40]["kept"] and got[41]["cleaned"] == ""
    assert got[44]["n_words"] == 6000 and quality_rules.clean_documents(docs).count() == docs.count()
    assert quality_rules.clean_documents(no_docs).count() == 0


def test_quality_classifier_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    scored = quality_classifier.classify(d, labels, crc_of_id() % 5 != 0).where(crc_of_id() % 5 == 0).join(labels, "doc_id")
    rows = scored.select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_quality_classifier_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(no_docs, labels).count() == 0
    assert all(r["score"] == 0.5 for r in quality_classifier.classify(docs, labels.limit(0)).collect())
