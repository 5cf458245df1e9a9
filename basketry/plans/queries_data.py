"""Queries of the integrity and quality checks and of the assumption profile."""

from __future__ import annotations

from ..operators import integrity as q
from ..schema import LABELS
from .catalog import register

_HH = "(SELECT DISTINCT household_key FROM tx)"


def _in(what: str, column: str, other: str) -> str:
    return f"SELECT count(*) FROM {what} WHERE {column} NOT IN (SELECT {column} FROM {other})"


def _repeat(what: str, keys: str) -> str:
    return f"SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {what} GROUP BY {keys})"


#: check id -> the SQL that counts its rows
COUNTS = {
    "X0": "SELECT count(*) FILTER (WHERE household_key IS NULL) + count(*) FILTER (WHERE product_id IS NULL) + count(*) FILTER (WHERE basket_id IS NULL) FROM tx",
    "X1": f"SELECT count(*) FROM {_HH}", "X2a": _in("mailings", "household_key", _HH), "X2b": _in("redemptions", "household_key", _HH), "X2c": _in("demographics", "household_key", _HH),
    "X3": _in("tx", "product_id", "products"), "X4": _in("mailings", "campaign", "campaigns"), "X5": _in("coupons", "campaign", "campaigns"),
    "X6": "SELECT count(*) FROM mailings JOIN campaigns USING (campaign) WHERE mailed_type <> campaign_type",
    "X7": "SELECT count(*) FROM redemptions WHERE (household_key, campaign) NOT IN (SELECT household_key, campaign FROM mailings)",
    "X8": "SELECT count(*) FROM redemptions JOIN campaigns USING (campaign) WHERE day NOT BETWEEN start_day AND end_day",
    "X9": "SELECT count(*) FROM redemptions WHERE (campaign, coupon_upc) NOT IN (SELECT campaign, coupon_upc FROM coupons)",
    "X10a": "SELECT count(*) FROM mailings", "X10b": _repeat("mailings", "household_key, campaign"),
    "X11": "SELECT count(*) FROM (SELECT DISTINCT household_key, campaign FROM mailings) WHERE (household_key, campaign) IN (SELECT household_key, campaign FROM redemptions)",
    "X12": "SELECT count(*) FROM tx WHERE ceil((day + 2) / 7.0) <> week_no", "X13": _repeat("products", "product_id"), "X14": _repeat("demographics", "household_key"),
    "X15": "SELECT count(*) FROM causal WHERE display NOT IN ('0','1','2','3','4','5','6','7','8','9','A') OR mailer NOT IN ('0','A','C','D','F','H','J','L','P','X','Z')",
    "Q1": _repeat("coupons", "ALL").replace("SELECT count(*) AS n FROM coupons", "SELECT coupon_upc, product_id, campaign, count(*) AS n FROM coupons"),
    "Q2": _repeat("redemptions", "household_key, day, coupon_upc, campaign"),
    "Q3": _repeat("tx", "household_key, basket_id, day, week_no, product_id, store_id, quantity, sales_cents, retail_disc_cents, coupon_disc_cents"),
    "Q4a": "SELECT count(*) FROM tx WHERE retail_disc_cents > 0.5", "Q4b": "SELECT count(*) FROM tx WHERE coupon_disc_cents > 0.5", "Q4c": "SELECT count(*) FROM tx WHERE retail_disc_cents + coupon_disc_cents > 0.5",
    "I5": "SELECT count(*) FROM tx WHERE (retail_disc_cents > 0 AND retail_disc_cents <= 0.5) OR (coupon_disc_cents > 0 AND coupon_disc_cents <= 0.5)",
    "Q5": "SELECT count(*) FROM tx WHERE quantity <= 0", "Q6": "SELECT count(*) FROM tx WHERE sales_cents <= 0", "Q7": "SELECT count(*) FROM tx WHERE quantity > 100",
    "Q8": "SELECT count(*) FROM campaigns WHERE end_day > (SELECT max(day) FROM tx)",
    "Q9": "SELECT count(*) FROM (SELECT 1 FROM causal GROUP BY product_id, store_id, week_no HAVING count(*) > 1)",
    "I1": "SELECT count(*) FROM (SELECT DISTINCT household_key, campaign FROM mailings) JOIN campaigns USING (campaign) JOIN (SELECT household_key, min(day) AS first FROM tx GROUP BY ALL) USING (household_key) WHERE start_day - first < 182",
    "I2": "SELECT count(*) FROM campaigns a JOIN campaigns b ON a.campaign < b.campaign AND a.start_day <= b.end_day AND b.start_day <= a.end_day",
    "I3": "SELECT count(*) FROM (SELECT 1 FROM coupons GROUP BY coupon_upc HAVING count(DISTINCT campaign) > 1)",
    "I4": f"SELECT count(*) FROM {_HH} WHERE household_key IN (SELECT household_key FROM demographics)",
}
_INFO = {"X1", "X10a", "X11", "I5", "I1", "I2", "I3", "I4"}


def _finding(k: str) -> str:
    if k in _INFO:
        kind, status = "integrity" if k == "X1" else "info", "'INFO'"
    else:
        kind = "quality" if k[0] == "Q" else "integrity"
        status = f"CASE WHEN n = 0 THEN 'OK' ELSE '{'FLAG' if k[0] == 'Q' else 'ERROR'}' END"
    return f"SELECT '{k}' AS check_id, '{kind}' AS kind, {status} AS status, n::BIGINT AS n_rows FROM (SELECT ({COUNTS[k]}) AS n)"


for _k in COUNTS:
    register(f"chk_{_k}", lambda t, k=_k: q.finding(k, *q.checks(t)[k]), _finding(_k))
_FOUND = " UNION ALL ".join(map(_finding, COUNTS))
register("findings", q.findings, _FOUND)
register("findings_summary", lambda t: q.summary(q.findings(t)), f"SELECT status, count(*)::BIGINT AS n_checks, sum(n_rows)::BIGINT AS n_rows FROM ({_FOUND}) GROUP BY status")
register("chk_X0_columns", q.null_keys, " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_null FROM {view}"
    for name, view, columns in (("transactions", "tx", ("household_key", "product_id", "basket_id")), ("coupons", "coupons", ("coupon_upc", "product_id", "campaign")), ("redemptions", "redemptions", ("household_key", "coupon_upc", "campaign")), ("mailings", "mailings", ("household_key", "campaign")), ("campaigns", "campaigns", ("campaign",)), ("products", "products", ("product_id",)))
    for c in columns))
register("prof_counts", q.profile_counts, f"""SELECT 'households' AS measure, count(*)::BIGINT AS value FROM {_HH} UNION ALL SELECT 'never_mailed', count(*) FROM {_HH} WHERE household_key NOT IN (SELECT household_key FROM mailings)
    UNION ALL SELECT 'mailings_' || campaign_type, count(*) FROM mailings JOIN campaigns USING (campaign) GROUP BY campaign_type""")
register("prof_discount_sign", q.discount_sign, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::BIGINT AS low, max({c})::BIGINT AS high, count(*) FILTER (WHERE {c} > 0)::BIGINT AS n_above_zero, count(*) FILTER (WHERE {c} < 0)::BIGINT AS n_below_zero FROM tx" for c in ("retail_disc_cents", "coupon_disc_cents")))
register("prof_ranges", q.ranges, """SELECT min(day) AS first_day, max(day) AS last_day, min(week_no) AS first_week, max(week_no) AS last_week, count(*) FILTER (WHERE quantity <= 0)::BIGINT AS n_no_quantity, count(*) FILTER (WHERE sales_cents <= 0)::BIGINT AS n_no_sales,
    max(quantity) AS most_quantity, max(sales_cents) AS most_sales_cents FROM tx""")
register("prof_day_week", q.day_week, """SELECT (SELECT count(*) FROM (SELECT 1 FROM tx GROUP BY day HAVING count(DISTINCT week_no) > 1))::BIGINT AS days_in_several_weeks, k::BIGINT AS best_offset, n_match::BIGINT AS n_match
    FROM (SELECT k, count(*) FILTER (WHERE ceil((day + k) / 7.0) = week_no) AS n_match FROM tx, range(0, 7) r(k) GROUP BY k ORDER BY n_match DESC LIMIT 1)""")
register("prof_campaign_order", q.campaign_order, """SELECT a.campaign, b.campaign AS other, coalesce(a.start_day >= a.before, true) AS in_order, a.start_day <= a.end_day AS valid_window FROM (SELECT *, lag(start_day) OVER (ORDER BY campaign) AS before FROM campaigns) a
    JOIN campaigns b ON a.campaign < b.campaign AND a.start_day <= b.end_day AND b.start_day <= a.end_day""")
register("prof_coupon_pool", q.coupon_pool, "SELECT campaign_type, min(n)::BIGINT AS least, median(n::DOUBLE) AS median, max(n)::BIGINT AS most FROM (SELECT campaign, count(DISTINCT coupon_upc) AS n FROM coupons GROUP BY ALL) JOIN campaigns USING (campaign) GROUP BY campaign_type")
register("prof_history", q.history, """SELECT count(*) FILTER (WHERE d <= 0)::BIGINT AS n_none, count(*) FILTER (WHERE d < 56)::BIGINT AS n_below_56, count(*) FILTER (WHERE d < 182)::BIGINT AS n_below_182, median(d::DOUBLE) AS median, min(d)::BIGINT AS least, max(d)::BIGINT AS most
    FROM (SELECT start_day - first AS d FROM mailings JOIN campaigns USING (campaign) JOIN (SELECT household_key, min(day) AS first FROM tx GROUP BY ALL) USING (household_key))""")
register("prof_categories", q.categories, " UNION ALL ".join(f"SELECT '{c}' AS label, {c} AS value, count(*)::BIGINT AS n FROM demographics GROUP BY {c}" for c in LABELS))
register("prof_promo_codes", q.promotion_codes, """SELECT count(*)::BIGINT AS n_rows, count(DISTINCT display)::BIGINT AS n_display, count(DISTINCT mailer)::BIGINT AS n_mailer,
    (SELECT count(*) FROM (SELECT 1 FROM causal GROUP BY product_id, store_id, week_no HAVING count(*) > 1))::BIGINT AS n_repeated_keys FROM causal""")
