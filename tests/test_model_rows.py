"""The rows of the models are chosen before profiles and outcomes are made, and past campaigns are counted without a row for each pair."""

import pytest

import basketry.plans.catalog  # noqa: F401  (first: it imports the queries)
from basketry.operators import health, outcomes, profile
from basketry.plans import binding, queries_models

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return queries_models.with_lines_stored(binding.tables(spark, D))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_profiles_are_made_for_a_models_rows_alone(spark, tables, k, monkeypatch):
    asked, make = [], profile.profiles
    monkeypatch.setattr(profile, "profiles", lambda t, rows: asked.append(rows.count()) or make(t, rows))
    got = queries_models.rows_of(binding.tables(spark, D), k)
    n = health.chosen_rows(tables, health.MODEL_ROWS[k]).count()
    assert asked == [n] and got.count() == n < tables.transactions.select("household_key").distinct().count() * tables.campaigns.count()


def test_one_outcome_is_that_of_all_outcomes(tables):
    rows = health.chosen_rows(tables, health.MODEL_ROWS[3])
    whole = outcomes.outcome_table(tables)
    for name in ("campaign_product_spend_during", "bought_excl_display_flyer", "bought_excl_display"):
        one = outcomes.outcome(tables, rows, name).select("household_key", "campaign", name)
        want = rows.select("household_key", "campaign").join(whole.select("household_key", "campaign", name), ["household_key", "campaign"])
        assert one.count() == want.count() > 0 and one.exceptAll(want).isEmpty()


def test_past_campaigns_with_ties_repeated_redemptions_and_the_cutoffs_own_day(spark, tables):
    dates = spark.createDataFrame([(1, "B", 10, 20), (2, "B", 10, 20), (3, "B", 21, 30), (4, "B", 31, 60)], "campaign long, campaign_type string, start_day long, end_day long")
    sent = spark.createDataFrame([(h, c) for h in (7, 8, 9) for c in (1, 2, 3, 4) if (h, c) != (9, 3)], "household_key long, campaign long")
    used = spark.createDataFrame([(7, 12, "a", 1), (7, 13, "a", 1), (7, 25, "c", 3), (8, 31, "c", 3), (8, 15, "b", 2), (9, 14, "b", 2)], "household_key long, day long, coupon_upc string, campaign long")
    rows = spark.createDataFrame([(h, 4, d) for h in (7, 8, 9, 10) for d in (5, 31)], "household_key long, campaign long, cutoff_day long")
    got = profile._past_campaigns(tables.with_(campaigns=dates, mailings=sent, redemptions=used), rows)
    found = {(r[0], r[2]): tuple(r[3:]) for r in got.collect()}
    assert found == {
        (7, 5): (0, 0, 0, None), (8, 5): (0, 0, 0, None), (9, 5): (0, 0, 0, None), (10, 5): (0, 0, 0, None), (10, 31): (0, 0, 0, None),
        (7, 31): (3, 3, 2, 1), (8, 31): (1, 3, 1, 0), (9, 31): (1, 2, 1, 1),
    }
    assert "Window" not in got._jdf.queryExecution().toString()


def test_columns_asked_for_are_those_of_the_whole_profile_and_make_nothing_else(spark, tables):
    rows = profile.cutoffs(health.chosen_rows(tables, health.MODEL_ROWS[2]))
    whole = profile.profiles(tables, rows)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joins = {}
    for asked in (["spend_per_week_26w"], [*profile.OF_PRODUCTS, "spend_per_week_8w"], list(profile.OF_PAST), [*profile.OF_KINDS, *profile.OF_LIVE], list(profile.OF_DEMOGRAPHICS), queries_models.FEW, queries_models.NUMBERS):
        got, want = profile.profiles_of(tables, rows, asked), whole.select(*profile.KEY, *asked)
        assert got.columns == want.columns and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
        joins[asked[0]] = plan(got)
    assert "part.parquet" in joins["n_departments_26w"] and "part.parquet" not in joins["spend_per_week_26w"]


def test_a_line_of_one_number_asks_for_no_other(spark, monkeypatch):
    asked, make = [], profile.profiles_of
    monkeypatch.setattr(profile, "profiles_of", lambda t, rows, columns: asked.append(columns) or make(t, rows, columns))
    queries_models._m2(binding.tables(spark, D))
    assert asked == [["spend_per_week_26w"]]
