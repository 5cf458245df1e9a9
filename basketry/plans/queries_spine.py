"""Queries of the grid."""

from __future__ import annotations

from ..operators import spine
from .catalog import register

DIM = """SELECT c.campaign, c.campaign_type, c.start_day, c.end_day, row_number() OVER (ORDER BY c.start_day, c.end_day, c.campaign)::BIGINT AS chrono_rank, (c.end_day - c.start_day + 1)::BIGINT AS duration_days,
    (SELECT count(*) FROM campaigns o WHERE o.campaign <> c.campaign AND o.start_day <= c.end_day AND o.end_day >= c.start_day)::BIGINT AS n_overlapping_campaigns,
    (CASE WHEN c.end_day > (SELECT max(day) FROM tx) THEN 1 ELSE 0 END)::BIGINT AS window_truncated_flag FROM campaigns c"""
SPINE = {
    "dim": DIM,
    "grid": "SELECT h.household_key, d.* FROM (SELECT DISTINCT household_key FROM tx) h, dim d",
    "redeemed_counts": """SELECT r.household_key, r.campaign, count(*)::BIGINT AS n_redemptions, count(*) FILTER (WHERE r.day BETWEEN k.start_day AND k.end_day)::BIGINT AS n_redemptions_in_window
        FROM redemptions r JOIN campaigns k USING (campaign) GROUP BY ALL""",
    "spine": """SELECT g.*, (CASE WHEN m.campaign IS NULL THEN 0 ELSE 1 END)::BIGINT AS mailed_flag, coalesce(r.n_redemptions, 0)::BIGINT AS n_redemptions, coalesce(r.n_redemptions_in_window, 0)::BIGINT AS n_redemptions_in_window,
        (CASE WHEN r.n_redemptions > 0 THEN 1 ELSE 0 END)::BIGINT AS redeemed_flag, f.first_txn_day, (CASE WHEN d.household_key IS NULL THEN 0 ELSE 1 END)::BIGINT AS has_demographics, g.start_day - f.first_txn_day AS history_days_before_start
        FROM grid g LEFT JOIN (SELECT DISTINCT household_key, campaign FROM mailings) m USING (household_key, campaign) LEFT JOIN redeemed_counts r USING (household_key, campaign)
        LEFT JOIN (SELECT household_key, min(day) AS first_txn_day FROM tx GROUP BY ALL) f USING (household_key) LEFT JOIN demographics d USING (household_key)""",
}
BASE = "household_key, campaign, campaign_type, start_day, end_day, chrono_rank, duration_days, n_overlapping_campaigns, window_truncated_flag"

register("campaign_dim", spine.campaign_dim, "SELECT * FROM dim", dim=DIM)
register("spine_grid", spine.grid, f"SELECT {BASE} FROM grid", **SPINE)
register("spine_mailed", spine.mailed, f"SELECT {BASE}, mailed_flag FROM spine", **SPINE)
register("spine_redeemed", spine.redeemed, f"SELECT {BASE}, mailed_flag, n_redemptions, n_redemptions_in_window, redeemed_flag FROM spine", **SPINE)
register("spine_history", lambda t: spine.spine(t).select("household_key", "campaign", "first_txn_day", "history_days_before_start", "has_demographics"), "SELECT household_key, campaign, first_txn_day, history_days_before_start, has_demographics FROM spine", **SPINE)
register(
    "spine_checks", spine.checks,
    """SELECT name, actual::BIGINT AS actual, expected::BIGINT AS expected FROM (SELECT 'rows' AS name, (SELECT count(*) FROM spine)::BIGINT AS actual, ((SELECT count(DISTINCT household_key) FROM tx) * (SELECT count(*) FROM campaigns))::BIGINT AS expected
    UNION ALL SELECT 'keys', (SELECT count(*) FROM (SELECT DISTINCT household_key, campaign FROM spine)), (SELECT count(DISTINCT household_key) FROM tx) * (SELECT count(*) FROM campaigns)
    UNION ALL SELECT 'mailed', (SELECT sum(mailed_flag) FROM spine), (SELECT count(*) FROM mailings WHERE household_key IN (SELECT household_key FROM tx))
    UNION ALL SELECT 'redeemed', (SELECT sum(redeemed_flag) FROM spine), (SELECT count(*) FROM (SELECT DISTINCT household_key, campaign FROM redemptions))
    UNION ALL SELECT 'redeemed_not_mailed', (SELECT count(*) FROM spine WHERE redeemed_flag = 1 AND mailed_flag = 0), 0 UNION ALL SELECT 'no_first_day', (SELECT count(*) FROM spine WHERE first_txn_day IS NULL), 0
    UNION ALL SELECT 'bad_duration', (SELECT count(*) FROM spine WHERE duration_days <= 0), 0 UNION ALL SELECT 'more_in_window', (SELECT count(*) FROM spine WHERE n_redemptions_in_window > n_redemptions), 0)""",
    **SPINE,
)
register(
    "spine_rates", spine.rates,
    """SELECT coalesce(campaign_type, 'all') AS campaign_type, count(*)::BIGINT AS mailed, sum(redeemed_flag)::BIGINT AS redeemed, sum(redeemed_flag)::DOUBLE / count(*) AS rate
    FROM spine WHERE mailed_flag = 1 GROUP BY ROLLUP (campaign_type)""",
    **SPINE,
)
register("prof_redemption_rate", spine.redemption_rate, """SELECT g AS "group", count(sent)::BIGINT AS mailings, count(sent + hit)::BIGINT AS redeemed, count(sent + hit)::DOUBLE / count(sent) AS rate, count_if(sent IS NULL)::BIGINT AS not_mailed
    FROM (SELECT sent, hit, unnest(['all', campaign_type]) AS g FROM (SELECT DISTINCT household_key, campaign, 1 AS sent FROM mailings) FULL JOIN (SELECT DISTINCT household_key, campaign, 1 AS hit FROM redemptions) USING (household_key, campaign) LEFT JOIN campaigns USING (campaign)) GROUP BY g""")
