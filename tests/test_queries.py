"""Registered queries against their SQL, on the driver's smallest tables. One query of each kind; the driver compares all."""

import math
import os

import pytest

from basketry.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["spine_rates", "spine_checks", "findings", "prof_categories", "out_bought", "promo_share", "prof_offer_spend", "prof_last_campaign", "within_capture", "campaign_auc", "campaign_qini", "forecast_range", "inner_folds", "product_lookup", "same_habit_auc", "q_by_category", "q_top_share", "corrected_values", "outlier_sensitivity", "typed_cast", "keyed_upsert", "rank_blend"]


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 8) if isinstance(x, float) else x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = catalog.QUERIES[name](spark, SF)
    found = con.execute(catalog.ORACLE_SQL[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in found.description], found.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry_works_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert "spine_rates" in entry.queries() and not any(k.startswith("op1_") for k in entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
