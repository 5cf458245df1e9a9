"""Queries of the columns tried beside the profile, and of what needs the shop's own coupon discounts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import analyses, candidates, integrity, outliers, profile, spine
from ..schema import Tables
from .catalog import register
from .queries_analyses import O, odd
from .queries_models import stored
from .queries_spine import SPINE

OWN_BRAND = "Brand#13"


def with_match(t: Tables) -> Tables:
    """Every third coupon line, by product and day, has a discount of the shop's own."""
    match = F.when((F.col("coupon_disc_cents") < 0) & ((F.col("product_id") + F.col("day")) % 3 == 0), -40).otherwise(0).cast("long")
    return t.with_(transactions=t.transactions.withColumn("match_disc_cents", match))


_K = "household_key, campaign, cutoff_day"
MATCH = {"txm": "SELECT *, (CASE WHEN coupon_disc_cents < 0 AND (product_id + day) % 3 = 0 THEN -40 ELSE 0 END)::BIGINT AS match_disc_cents FROM tx"}
_share = lambda a, b: f"CASE WHEN {b} > 0 THEN coalesce({a}, 0)::DOUBLE / {b} ELSE 0.0::DOUBLE END"
_weeks = lambda w: f"(least({7 * w}, coalesce(cutoff_day - first_day, 0)) / 7.0::DOUBLE)"
CANDIDATES = {
    **SPINE, **MATCH,
    "asked": "SELECT household_key, campaign, start_day AS cutoff_day FROM spine WHERE mailed_flag = 1",
    "ever": f"SELECT {_K}, min(day) AS first_day, max(day) FILTER (WHERE coupon_disc_cents < 0) AS last_coupon FROM asked JOIN tx USING (household_key) WHERE day < cutoff_day GROUP BY ALL",
    "seen": "SELECT product_id, store_id, week_no, bool_or(display <> '0') AS shown, bool_or(mailer <> '0') AS printed FROM causal GROUP BY ALL",
    "kinds": "SELECT DISTINCT campaign, commodity FROM cprod JOIN products USING (product_id)",
    "half": """SELECT a.campaign, a.cutoff_day, x.*, brand, shown, printed, cprod.campaign IS NOT NULL AS own, kinds.campaign IS NOT NULL AS kind FROM asked a JOIN txm x ON x.household_key = a.household_key AND x.day < a.cutoff_day AND x.day >= a.cutoff_day - 182
        LEFT JOIN products USING (product_id) LEFT JOIN seen USING (product_id, store_id, week_no) LEFT JOIN cprod ON cprod.campaign = a.campaign AND cprod.product_id = x.product_id LEFT JOIN kinds ON kinds.campaign = a.campaign AND kinds.commodity = products.commodity""",
    "halves": f"""SELECT {_K}, count(*) AS n, sum(sales_cents) AS cents, count_if(coupon_disc_cents < 0) AS c26, count_if(coupon_disc_cents < 0 AND day >= cutoff_day - 56) AS c8, -sum(coupon_disc_cents) FILTER (WHERE coupon_disc_cents < 0) AS saved, count_if(match_disc_cents < 0) AS matches,
        count(DISTINCT day) FILTER (WHERE coupon_disc_cents < 0) AS coupon_days, sum(sales_cents) FILTER (WHERE kind) AS kind_cents, count(DISTINCT product_id) FILTER (WHERE own) AS own_products, count(DISTINCT basket_id) AS trips, count(DISTINCT basket_id) FILTER (WHERE own) AS own_trips,
        sum(sales_cents) FILTER (WHERE brand = '{OWN_BRAND}') AS private_cents, sum(sales_cents) FILTER (WHERE shown) AS display_cents, sum(sales_cents) FILTER (WHERE printed) AS flyer_cents FROM half GROUP BY ALL""",
    "hits": f"SELECT {_K}, count(DISTINCT coupon_upc) AS matched FROM half JOIN coupons USING (campaign, product_id) GROUP BY ALL",
    "size_of": "SELECT campaign, count(DISTINCT coupon_upc) AS n_coupons, count(DISTINCT product_id) AS n_products FROM coupons GROUP BY campaign",
    "earlier": "SELECT a.*, r.day, r.coupon_upc, r.campaign AS other FROM asked a JOIN redemptions r ON r.household_key = a.household_key AND r.day < a.cutoff_day",
    "earlier_all": f"""SELECT {_K}, max(day) AS last_redemption, count_if((household_key, other) IN (SELECT household_key, campaign FROM mailings) AND other IN (SELECT k.campaign FROM campaigns k WHERE k.start_day < cutoff_day AND k.end_day >= cutoff_day)) AS live,
        count(DISTINCT coupon_upc) FILTER (WHERE (campaign, coupon_upc) IN (SELECT campaign, coupon_upc FROM coupons)) AS again FROM earlier GROUP BY ALL""",
    "visits": f"SELECT {_K}, store_id, count(*) AS n, count_if(coupon_disc_cents < 0) AS c FROM half GROUP BY ALL",
    "main": f"SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY n DESC, store_id) = 1",
    "at_store": "SELECT cutoff_day, store_id, count(*) AS n, count_if(coupon_disc_cents < 0) AS c FROM (SELECT DISTINCT cutoff_day FROM asked) JOIN tx ON day < cutoff_day AND day >= cutoff_day - 182 GROUP BY ALL",
    "elsewhere": f"SELECT {_K}, s.n - main.n AS other_n, s.c - main.c AS other_c FROM main JOIN at_store s USING (cutoff_day, store_id)",
}
_FLOATS = "coupon_trend_8w_minus_26w coupon_line_share_26w coupon_savings_per_week_26w coupon_match_lines_per_week_26w campaign_commodity_share_26w campaign_product_trip_share_26w campaign_coupons_matched_share private_label_share_26w main_store_coupon_line_share flyer_spend_share_26w display_spend_share_26w"

register("candidate_features", lambda t: candidates.candidate_features(with_match(t), profile.cutoffs(spine.mailed(t).where("mailed_flag = 1")), OWN_BRAND), f"""SELECT {_K}, {_share('c8', _weeks(8))} - {_share('c26', _weeks(26))} AS coupon_trend_8w_minus_26w,
    coalesce(cutoff_day - last_coupon, cutoff_day)::DOUBLE AS days_since_last_coupon, {_share('c26', 'n')} AS coupon_line_share_26w, {_share('saved / 100.0::DOUBLE', _weeks(26))} AS coupon_savings_per_week_26w, {_share('matches', _weeks(26))} AS coupon_match_lines_per_week_26w,
    coalesce(coupon_days, 0)::BIGINT AS coupon_days_26w, {_share('kind_cents', 'cents')} AS campaign_commodity_share_26w, coalesce(own_products, 0)::BIGINT AS campaign_products_bought_26w, {_share('own_trips', 'trips')} AS campaign_product_trip_share_26w,
    coalesce(matched, 0)::BIGINT AS campaign_coupons_matched, {_share('matched', 'n_coupons')} AS campaign_coupons_matched_share, coalesce(cutoff_day - last_redemption, cutoff_day)::DOUBLE AS days_since_last_redemption, coalesce(live, 0)::BIGINT AS redemptions_in_live_campaigns,
    coalesce(again, 0)::BIGINT AS redeemed_this_campaigns_coupons_before, {_share('private_cents', 'cents')} AS private_label_share_26w, {_share('other_c', 'other_n')} AS main_store_coupon_line_share, coalesce(n_coupons, 0)::BIGINT AS campaign_n_coupons, coalesce(n_products, 0)::BIGINT AS campaign_n_products,
    {_share('flyer_cents', 'cents')} AS flyer_spend_share_26w, {_share('display_cents', 'cents')} AS display_spend_share_26w
    FROM asked LEFT JOIN ever USING ({_K}) LEFT JOIN halves USING ({_K}) LEFT JOIN hits USING ({_K}) LEFT JOIN earlier_all USING ({_K}) LEFT JOIN elsewhere USING ({_K}) LEFT JOIN size_of USING (campaign)""", rounded=_FLOATS, **CANDIDATES)  # fmt: skip
register("prof_match_formula", lambda t: integrity.match_formula(with_match(t)), """SELECT count(*)::BIGINT AS n_lines, count_if(sales_cents - match_disc_cents > sales_cents)::DOUBLE / count(*) AS share_above, sum(sales_cents)::BIGINT AS sales_cents, sum(match_disc_cents)::BIGINT AS match_disc_cents
    FROM txm WHERE match_disc_cents < 0""", **MATCH)  # fmt: skip
register("input_checks", lambda t: integrity.input_checks(t, spine.redeemed(t), {"rows": 10, "mailed_rows": 10}), """SELECT 'rows' AS name, count(*)::BIGINT AS actual, 10::BIGINT AS expected, count(*) = 10 AS passed FROM spine UNION ALL SELECT 'mailed_rows', sum(mailed_flag)::BIGINT, 10, sum(mailed_flag) = 10 FROM spine
    UNION ALL SELECT 'redeemed_mailed_rows', count_if(mailed_flag = 1 AND redeemed_flag = 1)::BIGINT, NULL, NULL FROM spine UNION ALL SELECT 'weeks_off_rule', count_if(week_no <> (day + 8) // 7)::BIGINT, 0, count_if(week_no <> (day + 8) // 7) = 0 FROM tx""", **SPINE)  # fmt: skip


# Outlier levels beside the flags. A line's place among the lines of its basket and product, in the order of all its values, makes its key unique.
_LINE = ["basket_id", "product_id", "copy"]
_ORDER = ["household_key", "day", "week_no", "store_id", "quantity", "sales_cents", "retail_disc_cents", "coupon_disc_cents"]


def merged(t: Tables, limit: int = 40):
    copy = F.row_number().over(Window.partitionBy("basket_id", "product_id").orderBy(*_ORDER))
    lines = stored(odd(t).withColumn("copy", copy.cast("long")), "lines")
    values = outliers.fields(lines)
    levels = outliers.level_table(values, outliers.fences(values), _LINE)
    # lines without an eligible field have level 0 everywhere
    every = stored(lines.select(*_LINE).join(levels, _LINE, "left").fillna(0), "levels")
    return outliers.merge_stats(outliers.merge_levels(outliers.line_flags(lines, stored), every, _LINE, limit), limit)


_FENCED = {"quantity": "quantity > 0, quantity::DOUBLE", "sales": "sales_cents > 0, sales_cents::DOUBLE", "unit_price": "quantity > 0 AND sales_cents > 0, sales_cents::DOUBLE / quantity", "retail_disc": "retail_disc_cents < 0, -retail_disc_cents::DOUBLE", "coupon_disc": "coupon_disc_cents < 0, -coupon_disc_cents::DOUBLE"}


def _extreme(name: str, test: str) -> str:
    ok, value = test.split(", ")
    high, low = (f"(SELECT {c} FROM fence WHERE field = '{name}')" for c in ("extreme_high", "extreme_low"))
    outside = f"{value} > {high}" + (f" OR {value} < {low}" if name == "unit_price" else "")
    return f"coalesce(CASE WHEN {ok} THEN {outside} END, false)"


register("flag_merge", merged, f"""SELECT true AS have_outliers, count_if(is_non_merchandise)::BIGINT AS non_merch, count_if(quantity > 40)::BIGINT AS big_qty, count_if(quantity > 40 AND is_non_merchandise)::BIGINT AS big_qty_non_merch, count_if(no_department)::BIGINT AS no_dept,
    count_if(no_department AND quantity <= 0 AND sales_cents <= 0)::BIGINT AS no_dept_zero_line, count_if(NOT is_non_merchandise AND ({' OR '.join(_extreme(*x) for x in _FENCED.items())}))::BIGINT AS extreme_any FROM odd""", **O)  # fmt: skip


def _blank_shares(t: Tables):
    """Share of mailed households that bought nothing in the 8 weeks before each campaign: their spend a trip is blank."""
    asked = profile.cutoffs(spine.mailed(t).where("mailed_flag = 1"))
    days = t.transactions.select("household_key", "day").distinct()
    lately = candidates._near(asked, days, ["household_key"]).where("day >= cutoff_day - 56").select(*profile.KEY).distinct().withColumn("seen", F.lit(1))
    x = asked.join(lately, profile.KEY, "left").groupBy("campaign", "cutoff_day").agg((F.count_if(F.col("seen").isNull()) / F.count(F.lit(1))).alias("blank"))
    return x.withColumnRenamed("cutoff_day", "start_day")


register("unusual_blanks", lambda t: analyses.unusual_blanks(_blank_shares(t), "blank", "start_day", 0.5, 0.001), """SELECT campaign, start_day, blank, before, move, usual FROM (SELECT *, stddev_samp(move) OVER (ORDER BY start_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual
    FROM (SELECT *, lag(blank) OVER w AS before, blank - lag(blank) OVER w AS move, row_number() OVER w - 1 AS place FROM (SELECT campaign, cutoff_day AS start_day, count_if(NOT seen)::DOUBLE / count(*) AS blank
    FROM (SELECT a.*, EXISTS (SELECT 1 FROM tx WHERE tx.household_key = a.household_key AND day < cutoff_day AND day >= cutoff_day - 56) AS seen FROM asked a) GROUP BY ALL) WINDOW w AS (ORDER BY start_day)))
    WHERE place >= 4 AND move > 0.5 * usual AND move > 0.001""", rounded="blank before move usual", **SPINE, asked=CANDIDATES["asked"])  # fmt: skip
