"""Forward chaining scores every test campaign that has earlier ones."""

from types import SimpleNamespace

from basketry.operators import selection, splits
from basketry.plans import binding, catalog  # noqa: F401 (the catalog loads the queries)


def test_forward_predict_takes_every_fold(spark, monkeypatch):
    from basketry.plans import queries_models as q

    t, got = binding.tables(spark, "/root/testdata/sf0.001"), {}

    def judged(table, campaigns, candidates, default, label, rules, path):
        got.update(selection.Calendar(table, campaigns, label).outer(rules))
        return SimpleNamespace(predictions=None)

    monkeypatch.setattr(q.selection, "nested_selection", judged)
    q._forward(t)
    want = {}
    for r in splits.forward_folds(t.campaigns, 1000, 7).collect():
        want.setdefault(r["test_campaign"], set()).add(r["train_campaign"])
    assert {k: set(v) for k, v in got.items()} == want and len(want) > 2
