"""Queries of campaign-window outcomes and point-in-time features."""

from __future__ import annotations

from ..operators import outcomes, profile, spine
from ..schema import LABELS
from .catalog import register
from .queries_spine import SPINE

_WEEK = lambda day: f"ceil(({day} + 2) / 7.0)::BIGINT"
_FLAGS = ("bought_excl_display_flyer", "bought_excl_display", "bought_without_redemption")
OUTCOMES = {
    **SPINE,
    "bc": "FROM campaigns WHERE campaign_type IN ('B', 'C')",
    "shelf": "SELECT product_id, store_id, week_no, bool_or(display != '0') AS shown, bool_or(mailer != '0') AS printed FROM causal SEMI JOIN (FROM cprod SEMI JOIN bc USING (campaign)) USING (product_id) GROUP BY product_id, store_id, week_no",
    # one row a day of a campaign, so that lines meet campaigns on equal days
    "running": "SELECT campaign, campaign_type, unnest(range(start_day, end_day + 1)) AS day FROM campaigns",
    "window_lines": """SELECT tx.household_key, running.campaign, running.campaign_type, tx.product_id, tx.store_id, tx.week_no, tx.sales_cents FROM tx, running, cprod
        WHERE tx.day = running.day AND cprod.campaign = running.campaign AND cprod.product_id = tx.product_id""",
    "coupon_items": "SELECT household_key, campaign, product_id FROM redemptions JOIN coupons USING (campaign, coupon_upc) GROUP BY household_key, campaign, product_id",
    "judged": """SELECT w.*, i.household_key IS NOT NULL AS by_coupon, NOT coalesce(shown, FALSE) AS unshown, NOT (coalesce(shown, FALSE) OR coalesce(printed, FALSE)) AS plain
        FROM window_lines w LEFT JOIN shelf USING (product_id, store_id, week_no) LEFT JOIN coupon_items i USING (household_key, campaign, product_id)""",
    "totals": """SELECT household_key, campaign, campaign_type, sum(sales_cents) / 100.0::DOUBLE AS money, sum(sales_cents) FILTER (by_coupon) / 100.0::DOUBLE AS coupon_money,
        count_if(plain) > 0 AS any_plain, count_if(unshown) > 0 AS any_unshown, count_if(plain AND by_coupon) = 0 AS none_by_coupon FROM judged GROUP BY household_key, campaign, campaign_type""",
    "flags": f"SELECT household_key, campaign, any_plain::BIGINT AS {_FLAGS[0]}, any_unshown::BIGINT AS {_FLAGS[1]}, (any_plain AND none_by_coupon)::BIGINT AS {_FLAGS[2]} FROM totals WHERE campaign_type <> 'A'",
    # by campaigns first: which two meet, then who was sent either
    "meeting": "SELECT r.campaign, o.campaign AS other FROM running r JOIN running o USING (day) WHERE r.campaign <> o.campaign GROUP BY r.campaign, o.campaign",
    "also_mailed": "SELECT household_key, meeting.campaign FROM mailings JOIN meeting ON meeting.other = mailings.campaign SEMI JOIN tx USING (household_key) GROUP BY household_key, meeting.campaign",
    # each visit counts for the campaigns that start after it, by the store's tally so far
    "tally": "SELECT household_key, campaign, tx.store_id, count(*) AS visits FROM tx JOIN campaigns ON start_day > tx.day GROUP BY household_key, campaign, tx.store_id",
    "favourite": "SELECT household_key, campaign, arg_max(store_id, visits * 1000000 - store_id) AS store_id FROM tally GROUP BY household_key, campaign",
    "shelf_weeks": f"""SELECT campaign, store_id, count(DISTINCT week_no) AS n FROM shelf JOIN cprod USING (product_id) JOIN campaigns USING (campaign)
        WHERE (shown OR printed) AND week_no >= {_WEEK('start_day')} AND week_no <= {_WEEK('end_day')} GROUP BY campaign, store_id""",
    "shares": f"""SELECT household_key, campaign, coalesce(n, 0)::DOUBLE / (1 + {_WEEK('end_day')} - {_WEEK('start_day')})::DOUBLE AS campaign_promo_share
        FROM favourite JOIN bc USING (campaign) LEFT JOIN shelf_weeks USING (campaign, store_id)""",
    "outcomes": f"""SELECT household_key, campaign, coalesce(money, 0)::DOUBLE AS campaign_product_spend_during, if(redeemed_flag = 1, coalesce(coupon_money, 0), NULL)::DOUBLE AS redeemed_coupon_product_spend_during,
        {', '.join(f"if(s.campaign_type = 'A', NULL, coalesce({c}, 0))::DOUBLE AS {c}" for c in _FLAGS)}, (also_mailed.campaign IS NOT NULL)::BIGINT AS mailed_overlapping_campaign, campaign_promo_share
        FROM spine s LEFT JOIN totals USING (household_key, campaign) LEFT JOIN flags USING (household_key, campaign) LEFT JOIN also_mailed USING (household_key, campaign) LEFT JOIN shares USING (household_key, campaign)""",
}

register("promoted", outcomes.promoted, "SELECT product_id, store_id, week_no, shown::BIGINT AS on_display, printed::BIGINT AS in_flyer FROM shelf", **OUTCOMES)
register("buys", outcomes.buys, "SELECT * RENAME (sales_cents AS cents) FROM window_lines", **OUTCOMES)
register("out_spend", outcomes.spend, "SELECT household_key, campaign, money AS campaign_product_spend_during FROM totals", **OUTCOMES)
register("out_redeemed_spend", outcomes.redeemed_spend, "SELECT household_key, campaign, coupon_money AS redeemed_coupon_product_spend_during FROM totals WHERE coupon_money IS NOT NULL", **OUTCOMES)
register("out_bought", outcomes.bought, "SELECT * FROM flags", **OUTCOMES)
register("out_overlap", outcomes.overlap, "SELECT * FROM also_mailed", **OUTCOMES)
register("usual_store", outcomes.usual_store, "SELECT * FROM favourite", **OUTCOMES)
register("promo_share", outcomes.promo_share, "SELECT * FROM shares", **OUTCOMES)
register("outcome_table", outcomes.outcome_table, "SELECT * FROM outcomes", **OUTCOMES)

_KEY = "household_key, campaign, cutoff_day"
_IN = lambda w: f"day >= cutoff_day - {7 * w}"
_WEEKS = lambda w: f"(least({7 * w}, cutoff_day - first_day) / 7.0::DOUBLE)"
_NUMBER = lambda c: f"coalesce(try_cast(regexp_extract({c}, '(\\d+)$', 1) AS INT) + 1, 0)::BIGINT AS {c}_code"
PROFILE = {
    **OUTCOMES,
    "cut": "SELECT household_key, campaign, start_day AS cutoff_day FROM grid",
    "kinds": "SELECT DISTINCT campaign, commodity FROM cprod JOIN products USING (product_id)",
    "lines": """SELECT r.*, t.day, t.basket_id, t.product_id, t.sales_cents, t.retail_disc_cents, t.coupon_disc_cents < 0 AS coupon, p.department, p.commodity, c.campaign IS NOT NULL AS own, k.campaign IS NOT NULL AS own_kind
        FROM cut r JOIN tx t ON t.household_key = r.household_key AND t.day < r.cutoff_day LEFT JOIN products p ON p.product_id = t.product_id LEFT JOIN cprod c ON c.campaign = r.campaign AND c.product_id = t.product_id
        LEFT JOIN kinds k ON k.campaign = r.campaign AND k.commodity = p.commodity""",
    "sums": f"""SELECT {_KEY}, min(day) AS first_day, max(day) AS last_day, coalesce(sum(sales_cents) FILTER (WHERE {_IN(8)}), 0) AS cents_8, coalesce(sum(sales_cents) FILTER (WHERE {_IN(26)}), 0) AS cents_26,
        coalesce(sum(sales_cents) FILTER (WHERE {_IN(26)} AND retail_disc_cents < 0), 0) AS discount_26, count(*) FILTER (WHERE coupon AND {_IN(8)}) AS coupons_8, count(*) FILTER (WHERE coupon AND {_IN(26)}) AS coupons_26, count(*) FILTER (WHERE coupon) AS coupons_all,
        coalesce(sum(sales_cents) FILTER (WHERE own AND {_IN(26)}), 0) AS own_cents, count(*) FILTER (WHERE own AND coupon AND {_IN(26)}) AS own_coupons, count(*) FILTER (WHERE own_kind AND coupon AND {_IN(26)}) AS kind_coupons,
        count(DISTINCT department) FILTER (WHERE {_IN(26)}) AS departments, count(DISTINCT commodity) FILTER (WHERE coupon AND {_IN(26)}) AS coupon_commodities,
        count(DISTINCT basket_id) FILTER (WHERE {_IN(8)}) AS trips_8, count(DISTINCT basket_id) FILTER (WHERE {_IN(26)}) AS trips_26, count(DISTINCT basket_id) FILTER (WHERE coupon AND {_IN(26)}) AS coupon_trips_26 FROM lines GROUP BY ALL""",
    "all_sums": f"""SELECT {_KEY}, first_day, last_day, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in ('cents_8', 'cents_26', 'discount_26', 'coupons_8', 'coupons_26', 'coupons_all', 'own_cents', 'own_coupons', 'kind_coupons', 'departments', 'coupon_commodities', 'trips_8', 'trips_26', 'coupon_trips_26'))}
        FROM cut LEFT JOIN sums USING ({_KEY})""",
    "past_r": "SELECT r.*, x.campaign AS past, x.coupon_upc FROM cut r JOIN redemptions x ON x.household_key = r.household_key AND x.day < r.cutoff_day",
    "ended": f"""SELECT r.*, k.end_day AS past_end, (CASE WHEN h.past IS NULL THEN 0 ELSE 1 END)::BIGINT AS hit, rank() OVER (PARTITION BY {', '.join('r.' + c for c in _KEY.split(', '))} ORDER BY k.end_day DESC) AS newest FROM cut r JOIN mailings m ON m.household_key = r.household_key
        JOIN campaigns k ON k.campaign = m.campaign AND k.end_day < r.cutoff_day LEFT JOIN (SELECT DISTINCT {_KEY}, past FROM past_r) h ON h.household_key = r.household_key AND h.campaign = r.campaign AND h.cutoff_day = r.cutoff_day AND h.past = m.campaign""",
    "past": f"""SELECT {_KEY}, coalesce(n, 0)::BIGINT AS past_redemptions, coalesce(received, 0)::BIGINT AS past_campaigns_received, coalesce(redeemed, 0)::BIGINT AS past_campaigns_redeemed, redeemed::DOUBLE / received AS past_redemption_rate, last AS redeemed_last_campaign FROM cut
        LEFT JOIN (SELECT {_KEY}, count(*) AS n FROM past_r GROUP BY ALL) USING ({_KEY}) LEFT JOIN (SELECT {_KEY}, count(*) AS received, sum(hit) AS redeemed, max(hit) FILTER (WHERE newest = 1) AS last FROM ended GROUP BY ALL) USING ({_KEY})""",
    "kind_r": f"""SELECT {_KEY}, count(DISTINCT coupon_upc) AS n FROM past_r WHERE (campaign, coupon_upc) IN (SELECT k.campaign, c.coupon_upc FROM coupons c JOIN products USING (product_id) JOIN kinds k ON k.commodity = products.commodity) GROUP BY ALL""",
    "live": f"""SELECT r.household_key, r.campaign, r.cutoff_day, count(*) AS n FROM cut r JOIN mailings m ON m.household_key = r.household_key AND m.campaign <> r.campaign JOIN campaigns k ON k.campaign = m.campaign AND k.start_day < r.cutoff_day AND k.end_day >= r.cutoff_day GROUP BY ALL""",
    "profile": f"""SELECT {_KEY}, coalesce(cutoff_day - first_day, 0) / 7.0::DOUBLE AS history_weeks_before_cutoff, (coalesce(cutoff_day - first_day, 0) < 182)::BIGINT AS short_history_flag, (first_day IS NULL)::BIGINT AS no_history_flag,
        {', '.join(f"CASE WHEN first_day IS NOT NULL THEN cents_{w} / 100.0::DOUBLE / {_WEEKS(w)} END AS spend_per_week_{w}w, CASE WHEN first_day IS NOT NULL THEN trips_{w} / {_WEEKS(w)} END AS trips_per_week_{w}w, CASE WHEN first_day IS NOT NULL THEN coupons_{w} / {_WEEKS(w)} END AS coupon_lines_per_week_{w}w" for w in (8, 26))},
        CASE WHEN cents_26 > 0 THEN cents_26 / 100.0::DOUBLE / trips_26 END AS avg_basket_value_26w, cutoff_day - last_day AS days_since_last_trip, CASE WHEN first_day IS NOT NULL THEN departments END::BIGINT AS n_departments_26w,
        CASE WHEN cents_26 > 0 THEN discount_26 / cents_26 END AS share_spend_on_discount_26w, CASE WHEN first_day IS NOT NULL THEN coupons_all / ((cutoff_day - first_day) / 7.0::DOUBLE) END AS coupon_lines_per_week_all,
        CASE WHEN trips_26 > 0 THEN coupon_trips_26 / trips_26 END AS coupon_trip_share_26w, CASE WHEN first_day IS NOT NULL THEN coupon_commodities END::BIGINT AS coupon_commodities_26w,
        CASE WHEN first_day IS NOT NULL THEN own_cents / 100.0::DOUBLE / {_WEEKS(26)} END AS campaign_product_spend_per_week_26w, CASE WHEN cents_26 > 0 THEN own_cents / cents_26 END AS campaign_product_share_26w,
        CASE WHEN first_day IS NOT NULL THEN own_coupons / {_WEEKS(26)} END AS campaign_product_coupon_lines_per_week_26w, CASE WHEN first_day IS NOT NULL THEN kind_coupons / {_WEEKS(26)} END AS campaign_commodity_coupon_lines_per_week_26w,
        past_redemptions, past_campaigns_received, past_campaigns_redeemed, past_redemption_rate, redeemed_last_campaign, coalesce(kind_r.n, 0)::BIGINT AS past_redemptions_in_campaign_commodities, coalesce(live.n, 0)::BIGINT AS other_campaigns_live_at_cutoff,
        {', '.join(LABELS)}, {', '.join(f'coalesce({c}_code, 0) AS {c}_code' for c in LABELS)}
        FROM all_sums LEFT JOIN past USING ({_KEY}) LEFT JOIN kind_r USING ({_KEY}) LEFT JOIN live USING ({_KEY}) LEFT JOIN demographics d USING (household_key) LEFT JOIN codes USING (household_key)""",
}
PROFILE = {**{k: v for k, v in PROFILE.items() if k != "profile"}, "codes": f"""SELECT household_key, {', '.join(_NUMBER(c) for c in LABELS if c != 'marital')},
    coalesce(list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], marital), 0)::BIGINT AS marital_code FROM demographics""", "profile": PROFILE["profile"]}  # fmt: skip

#: query -> columns
PARTS = {
    "prof_history_weeks": "history_weeks_before_cutoff, short_history_flag, no_history_flag", "prof_activity": "spend_per_week_8w, spend_per_week_26w, trips_per_week_8w, trips_per_week_26w",
    "prof_basket": "avg_basket_value_26w", "prof_recency": "days_since_last_trip", "prof_departments": "n_departments_26w", "prof_discount_share": "share_spend_on_discount_26w",
    "prof_coupon_lines": "coupon_lines_per_week_26w, coupon_lines_per_week_8w, coupon_lines_per_week_all", "prof_coupon_trips": "coupon_trip_share_26w", "prof_coupon_breadth": "coupon_commodities_26w",
    "prof_past_redemptions": "past_redemptions", "prof_past_campaigns": "past_campaigns_received, past_campaigns_redeemed, past_redemption_rate", "prof_last_campaign": "redeemed_last_campaign",
    "prof_offer_spend": "campaign_product_spend_per_week_26w, campaign_product_share_26w", "prof_offer_coupons": "campaign_product_coupon_lines_per_week_26w, campaign_commodity_coupon_lines_per_week_26w",
    "prof_offer_redemptions": "past_redemptions_in_campaign_commodities", "prof_live_campaigns": "other_campaigns_live_at_cutoff", "prof_demographics": ", ".join(LABELS), "prof_demo_codes": ", ".join(f"{c}_code" for c in LABELS),
}
for _name, _columns in PARTS.items():
    _list = [*_KEY.split(", "), *_columns.split(", ")]
    register(_name, lambda t, c=_list: profile.profiles(t, profile.cutoffs(spine.grid(t))).select(*c), f"SELECT {', '.join(_list)} FROM profile", **PROFILE)
register("prof_asof_single", lambda t: profile.features(t, 1, 5, 1500), "SELECT * FROM profile", **{**PROFILE, "cut": "SELECT 1::BIGINT AS household_key, 5::BIGINT AS campaign, 1500::BIGINT AS cutoff_day"})
