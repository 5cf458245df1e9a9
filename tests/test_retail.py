"""Hand-computed cases of the retail operators, on three households, three campaigns and three products."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import analyses, decision, health, integrity, metrics, models, outcomes, outliers, profile, spine, splits
from basketry.schema import LABELS, Tables
from basketry.sources import ingest


@pytest.fixture(scope="module")
def t(spark):
    def frame(columns, *rows):
        return spark.createDataFrame(list(rows), columns)

    # household, basket, day, week, product, store, quantity, cents, retail discount, coupon discount
    lines = [
        (1, 10, 20, 4, 1, 1, 1, 1000, -100, 0), (1, 11, 60, 9, 2, 1, 1, 2000, 0, -50), (1, 12, 100, 15, 1, 1, 1, 5000, 0, 0), (1, 13, 132, 20, 1, 1, 1, 700, 0, -50), (1, 14, 133, 20, 1, 2, 1, 900, 0, 0),
        (2, 20, 95, 14, 3, 2, 1, 300, 0, 0), (2, 21, 110, 16, 1, 2, 1, 400, 0, 0), (2, 21, 110, 16, 1, 2, 1, 400, 0, 0), (3, 30, 90, 14, 2, 1, 2, 600, 0, 0), (3, 31, 105, 16, 2, 1, 1, 250, 0, 0),
    ]
    return Tables(
        frame("household_key long, basket_id long, day long, week_no long, product_id long, store_id long, quantity long, sales_cents long, retail_disc_cents long, coupon_disc_cents long", *lines),
        frame("campaign long, campaign_type string, start_day long, end_day long", (1, "B", 100, 132), (2, "C", 120, 200), (3, "A", 300, 330)),
        frame("campaign long, product_id long, coupon_upc string", (1, 1, "u1"), (1, 2, "u2"), (1, 2, "u2"), (2, 3, "u3"), (3, 1, "u1")),
        frame("household_key long, campaign long", (1, 1), (2, 1), (1, 2)),
        frame("household_key long, day long, coupon_upc string, campaign long", (1, 132, "u1", 1)),
        frame("product_id long, store_id long, week_no long, display string, mailer string", (1, 2, 16, "0", "0"), (1, 2, 16, "5", "0"), (2, 1, 16, "0", "A")),
        frame("product_id long, department string, commodity string, brand string", (1, "GROCERY", "milk", "x"), (2, "GROCERY", "bread", "x"), (3, "FUEL", "gas", "y")),
        frame("household_key long, " + ", ".join(f"{c} string" for c in LABELS), (1, "age1", "HOUSEHOLD", "inc2", "home0", "comp1", "size3", "kid0")),
    )


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_campaigns_in_time(t):
    d = rows(spine.campaign_dim(t), "campaign")
    assert d[1,]["n_overlapping_campaigns"] == 1 and d[3,]["n_overlapping_campaigns"] == 0
    assert [d[k,]["chrono_rank"] for k in (1, 2, 3)] == [1, 2, 3] and d[1,]["duration_days"] == 33 and d[2,]["window_truncated_flag"] == 1


def test_grid_flags(t):
    s = rows(spine.spine(t), "household_key", "campaign")
    assert len(s) == 9 and s[1, 1]["redeemed_flag"] == 1 and s[1, 1]["n_redemptions_in_window"] == 1 and s[2, 1]["mailed_flag"] == 1 and s[3, 1]["mailed_flag"] == 0
    assert s[1, 1]["history_days_before_start"] == 80 and s[1, 1]["has_demographics"] == 1 and s[2, 1]["has_demographics"] == 0
    assert all(r["actual"] == r["expected"] for r in spine.checks(t).collect())


def test_the_cutoff_day_itself_does_not_count(t):
    p = profile.features(t, 1, 1, 100).first()
    weeks = 80 / 7
    assert p["spend_per_week_26w"] == pytest.approx(30.0 / weeks) and p["trips_per_week_26w"] == pytest.approx(2 / weeks) and p["days_since_last_trip"] == 40
    assert p["spend_per_week_8w"] == pytest.approx(20.0 / 8) and p["avg_basket_value_26w"] == pytest.approx(15.0) and p["share_spend_on_discount_26w"] == pytest.approx(1 / 3)
    assert p["coupon_trip_share_26w"] == 0.5 and p["past_redemptions"] == 0 and p["past_redemption_rate"] is None
    assert p["campaign_product_share_26w"] == 1.0 and p["age_code"] == 2 and p["marital_code"] == 4


def test_no_history_is_null_with_a_flag(t):
    p = profile.features(t, 3, 1, 90).first()
    assert p["no_history_flag"] == 1 and p["spend_per_week_26w"] is None and p["n_departments_26w"] is None and p["income"] is None and p["income_code"] == 0


def test_past_campaigns(t):
    p = profile.features(t, 1, 3, 300).first()
    assert p["past_campaigns_received"] == 2 and p["past_campaigns_redeemed"] == 1 and p["redeemed_last_campaign"] == 0 and p["past_redemption_rate"] == 0.5
    assert p["past_redemptions_in_campaign_commodities"] == 1 and profile.features(t, 1, 2, 130).first()["other_campaigns_live_at_cutoff"] == 1


def test_windows_are_closed_and_promotions_set_aside(t):
    o = rows(outcomes.outcome_table(t), "household_key", "campaign")
    assert o[1, 1]["campaign_product_spend_during"] == 57.0 and o[1, 1]["redeemed_coupon_product_spend_during"] == 57.0 and o[2, 1]["redeemed_coupon_product_spend_during"] is None
    assert o[1, 1]["bought_excl_display_flyer"] == 1 and o[1, 1]["bought_without_redemption"] == 0
    assert o[2, 1]["bought_excl_display"] == 0  # any row of a conflicting promotion counts
    assert o[3, 1]["bought_excl_display_flyer"] == 0 and o[3, 1]["bought_excl_display"] == 1
    assert o[1, 3]["bought_excl_display"] is None and o[1, 2]["mailed_overlapping_campaign"] == 1 and o[2, 2]["mailed_overlapping_campaign"] == 1 and o[3, 2]["mailed_overlapping_campaign"] == 0
    assert o[3, 1]["campaign_promo_share"] == pytest.approx(1 / 6)


def test_checks_find_what_is_planted(t):
    found = {r["check_id"]: r for r in integrity.findings(t).collect()}
    assert found["Q1"]["n_rows"] == 1 and found["Q3"]["n_rows"] == 1 and found["Q9"]["n_rows"] == 1 and found["X3"]["status"] == "OK" and found["I2"]["n_rows"] == 1 and found["X7"]["status"] == "OK"


def test_nothing_leaks_from_the_future_and_a_peek_does(t):
    columns = ["spend_per_week_26w", "past_redemptions", "coupon_lines_per_week_all"]
    assert {r["column"]: r["n_changed"] for r in health.leak_test(t, profile.profiles, columns).collect()} == dict.fromkeys(columns, 0)

    def peek(tables, rows):
        every = tables.transactions.groupBy("household_key").agg(F.sum("sales_cents").alias("spend_per_week_26w"))
        return profile.profiles(tables, rows).drop("spend_per_week_26w").join(every, "household_key", "left")

    got = {r["column"]: r["n_changed"] for r in health.leak_test(t, peek, columns).collect()}
    assert got["spend_per_week_26w"] > 0 == got["past_redemptions"]


def test_blanks_have_reasons(t):
    assert all(r["n_unexplained"] == 0 for r in health.unexplained_blanks(health.feature_table(t)).collect())


def test_capture_auc_and_ties(spark):
    d = spark.createDataFrame([(1, k, s, y) for k, (s, y) in enumerate([(0.9, 1), (0.8, 0), (0.5, 1), (0.5, 0), (0.1, 0)])], "campaign long, household_key long, s double, y long")
    assert metrics.auc(d, "s", "y").first()["auc"] == pytest.approx(4.5 / 6)
    assert metrics.capture(d, "s", "y", 0.4).first()[0] == 0.5 and metrics.capture(d, "s", "y", 0.6, ["campaign"]).first()[0] == pytest.approx(0.75)
    assert metrics.random_capture(d, "y", ["campaign"]).first()["capture"] == pytest.approx(0.2)


def test_z_and_e_values(spark):
    d = spark.createDataFrame([(1, 1)] * 30 + [(1, 0)] * 70 + [(0, 1)] * 20 + [(0, 0)] * 80, "t long, y long")
    r = analyses.ate_test(d, "y", "t").first()
    assert r["z"] == pytest.approx(1.6330, abs=1e-4) and r["p_value"] == pytest.approx(0.10247, abs=1e-4)
    assert spark.range(1).select(metrics.e_value(F.lit(0.4), F.lit(0.2)), metrics.e_value(F.lit(0.2), F.lit(0.2)), metrics.e_value(F.lit(0.0), F.lit(0.2))).first()[:] == (pytest.approx(2 + 2**0.5), None, None)


def test_a_good_order_has_the_greater_qini(spark):
    d = spark.createDataFrame([(1, i, i % 2, 1 if i % 2 and i > 60 else 0, i / 100, (100 - i) / 100) for i in range(100)], "campaign long, household_key long, t long, y long, good double, bad double")
    good, bad = (metrics.stratified_qini(d, s, "y", "t").first()[0] for s in ("good", "bad"))
    assert good > 0 > bad


def test_bootstrap_is_seeded_and_tells_a_clear_winner(spark):
    d = spark.createDataFrame([(c, 100 * c + i, i % 10 == 0, float(i % 10 == 0), i / 50) for c in range(4) for i in range(50)], "campaign long, household_key long, y boolean, best double, worst double").withColumnRenamed("y", "yb").selectExpr("*", "CAST(yb AS LONG) AS y")
    a, b = (metrics.bootstrap_capture(d, "best", "worst", "y", ["household_key"], reps=10).first() for _ in range(2))
    assert a == b and a["verdict"] == "pass"


def test_splits(t):
    f = splits.forward_folds(t.campaigns, 120, 0).collect()
    assert {(r["test_campaign"], r["train_campaign"]) for r in f} == {(3, 1), (3, 2)}
    assert {r["campaign"]: r["part"] for r in splits.split_70_30(t.campaigns).collect()} == {1: "train", 2: "train", 3: "test"}
    assert splits.asof_calendar(t.campaigns, 150).first()["running"] == 1
    with pytest.raises(ValueError):
        splits.fill_blanks(t.products, {"department": {"unknown"}}, {"none"})


def test_fences_fall_back_to_percentiles(spark):
    v = spark.createDataFrame([("quantity", 1.0)] * 99 + [("quantity", 50.0)], "field string, value double")
    assert outliers.fences(v).first()["method"] == "percentile"


def test_questions(spark, t):
    table = spark.createDataFrame([(1, 1, 0.5, 1.0, 2.0, True), (2, 1, 0.9, 0.0, 3.0, True), (3, 1, 0.5, 0.0, 1.0, False)], "household_key long, campaign long, p_redeem double, redeemed double, spend double, has_demographics boolean")
    assert [r["household_key"] for r in decision.top(table, "p_redeem", 2).collect()] == [2, 1]
    assert [r["household_key"] for r in decision.top(table, "p_redeem", share=0.34).collect()] == [2, 1]
    assert decision.top_reach(table, "p_redeem", 2).first()["at_random"] == pytest.approx(2 / 3)
    assert [r["category"] for r in decision.find_category(decision.campaign_categories(t), "mlik").collect()][0] == "milk"


def test_raw_files(spark, tmp_path):
    (tmp_path / "coupon.csv").write_text("COUPON_UPC,product_id,CAMPAIGN,EXTRA\n00123,1,1,x\n00123,1,1,x\n00124,2,,x\n00125,y,1,x\n")
    clean, report = ingest.load_and_validate(spark, str(tmp_path / "coupon.csv"), "coupon", ingest.raw_specs()["coupon"])
    r = report.first()
    assert r["status"] == "OK_WITH_WARNINGS" and (r["n_raw"], r["n_null_dropped"]) == (4, 1) and "unexpected EXTRA" in r["problems"]
    assert clean.schema["PRODUCT_ID"].dataType.simpleString() == "string" and clean.where("COUPON_UPC = '00123'").count() == 1
    assert ingest.load_and_validate(spark, str(tmp_path / "none.csv"), "coupon", ingest.raw_specs()["coupon"])[1].first()["status"] == "MISSING"


def test_lines_and_weights(spark):
    d = spark.createDataFrame([(i, float(i), 3 + 2.0 * i + (100 if i == 9 else 0), int(i > 6)) for i in range(20)], "household_key long, x double, y double, t int")
    slope, intercept = models.median_line(d, "x", "y")
    assert slope == pytest.approx(2, abs=0.05) and intercept == pytest.approx(3, abs=0.5)
    w = models.entropy_weights(d.selectExpr("*", "x % 5 AS z"), ["z"], "t")
    want = d.where("t = 1").selectExpr("avg(x % 5)").first()[0]
    assert w.selectExpr("sum(entropy_weight * z) / sum(entropy_weight)").first()[0] == pytest.approx(want, abs=1e-6)
    assert models.entropy_weights(d, ["x"], "t") is None
