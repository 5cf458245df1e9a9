"""Queries of analyses, the decision table and its questions, outliers and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyses as a
from ..operators import decision as d
from ..operators import metrics as m
from ..operators import outliers as o
from ..schema import LABELS
from . import scored as s
from .catalog import register
from .queries_metrics import M, _caught, on
from .queries_models import stored

A = {
    **M,
    "mailed_pairs": "SELECT DISTINCT household_key, campaign FROM mailings",
    "control": "SELECT household_key, campaign FROM grid WHERE (household_key, campaign) NOT IN (SELECT household_key, campaign FROM mailed_pairs) AND (household_key, campaign) NOT IN (SELECT household_key, campaign FROM also_mailed)",
    "plain_buys": "SELECT household_key, campaign, product_id FROM judged WHERE plain AND campaign_type <> 'A' GROUP BY household_key, campaign, product_id",
    "product_uplift": """SELECT e.campaign, e.product_id, coalesce(n_treated_bought, 0)::BIGINT AS n_treated_bought, coalesce(n_control_bought, 0)::BIGINT AS n_control_bought, coalesce(n_without_redemption, 0)::BIGINT AS n_without_redemption, coalesce(n_treated_bought, 0)::DOUBLE / n_mailed AS treated_rate,
        coalesce(n_control_bought, 0)::DOUBLE / n_control AS control_rate, coalesce(n_treated_bought, 0)::DOUBLE / n_mailed - coalesce(n_control_bought, 0)::DOUBLE / n_control AS uplift FROM cprod e JOIN campaigns k ON k.campaign = e.campaign AND k.campaign_type <> 'A'
        LEFT JOIN (SELECT b.campaign, b.product_id, count(*) FILTER (WHERE p.campaign IS NOT NULL) AS n_treated_bought, count(*) FILTER (WHERE c.campaign IS NOT NULL) AS n_control_bought, count(*) FILTER (WHERE p.campaign IS NOT NULL AND r.campaign IS NULL) AS n_without_redemption
            FROM plain_buys b LEFT JOIN mailed_pairs p ON p.household_key = b.household_key AND p.campaign = b.campaign LEFT JOIN control c ON c.household_key = b.household_key AND c.campaign = b.campaign
            LEFT JOIN coupon_items r ON r.household_key = b.household_key AND r.campaign = b.campaign AND r.product_id = b.product_id GROUP BY b.campaign, b.product_id) n ON n.campaign = e.campaign AND n.product_id = e.product_id
        LEFT JOIN (SELECT campaign, count(*) AS n_mailed FROM mailed_pairs WHERE household_key IN (SELECT household_key FROM tx) GROUP BY campaign) x ON x.campaign = e.campaign LEFT JOIN (SELECT campaign, count(*) AS n_control FROM control GROUP BY campaign) y ON y.campaign = e.campaign""",
}
_RATES = "count(*)::BIGINT AS n, count(*) FILTER (WHERE treatment = 1)::BIGINT AS n_treated, avg(label) FILTER (WHERE treatment = 1) AS treated_rate, avg(label) FILTER (WHERE treatment <> 1) AS control_rate, avg(label) FILTER (WHERE treatment = 1) - avg(label) FILTER (WHERE treatment <> 1) AS uplift"
_R3 = "treated_rate control_rate uplift"

register("ate_test", on(lambda x: a.ate_test(x, "label", "treatment").drop("p_value")), """SELECT pt AS treated_rate, pc AS control_rate, pt - pc AS uplift, (pt - pc) / sqrt(p * (1 - p) * (1::DOUBLE / nt + 1::DOUBLE / nc)) AS z FROM (SELECT *, yt::DOUBLE / nt AS pt, yc::DOUBLE / nc AS pc, (yt + yc)::DOUBLE / (nt + nc) AS p
    FROM (SELECT count(*) FILTER (WHERE treatment = 1) AS nt, count(*) FILTER (WHERE treatment <> 1) AS nc, sum(label) FILTER (WHERE treatment = 1) AS yt, sum(label) FILTER (WHERE treatment <> 1) AS yc FROM scored))""", rounded="treated_rate control_rate uplift z", **A)
register("ate_p_value", on(lambda x: a.ate_test(x, "label", "treatment").select("z", "p_value")))
register("spend_tiers", on(lambda x: a.spend_tiers(x, "usual_spend", "label", "treatment")), f"""SELECT CASE WHEN usual_spend <= c[1] THEN 'low' WHEN usual_spend <= c[2] THEN 'medium' ELSE 'high' END AS tier, {_RATES} FROM scored, (SELECT quantile_cont(usual_spend, [1.0/3, 2.0/3]) AS c FROM scored WHERE treatment = 1) GROUP BY 1""", rounded=_R3, **A)
register("predicted_by_tier", on(lambda x: m.binned(x, "usual_spend", 3).groupBy("bin").agg(F.avg("score").alias("predicted"))), "SELECT len(list_filter(e, lambda y: usual_spend > y))::BIGINT AS bin, avg(score) AS predicted FROM scored, (SELECT quantile_cont(usual_spend, [1.0/3, 2.0/3]) AS e FROM scored) GROUP BY 1", rounded="predicted", **A)
register("demo_uplift", lambda t: a.demographic_uplift(s.scored(t), t.demographics, "income", "label", "treatment"), f"SELECT income, {_RATES} FROM scored JOIN demographics USING (household_key) GROUP BY income HAVING count(*) FILTER (WHERE treatment = 1) >= 20", rounded=_R3, **A)
register("redemption_split", on(lambda x: a.redemption_split(x, 5)), "SELECT campaign, count(*)::BIGINT AS n_buyers, count(*) FILTER (WHERE redeemed = 0)::BIGINT AS n_without, count(*) FILTER (WHERE redeemed = 0)::DOUBLE / count(*) AS share_without FROM scored WHERE treatment = 1 AND label = 1 GROUP BY campaign HAVING count(*) >= 5", rounded="share_without", **A)
register("selection_bias", on(lambda x: a.selection_bias(x, ["usual_spend", "spend"], "treatment")), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) FILTER (WHERE treatment = 1) AS treated, avg({c}) FILTER (WHERE treatment <> 1) AS control, avg({c}) FILTER (WHERE treatment = 1) / avg({c}) FILTER (WHERE treatment <> 1) AS ratio FROM scored" for c in ("usual_spend", "spend")), rounded="treated control ratio", **A)
register("common_support", on(lambda x: m.uplift_in(a.common_support(x, "usual_spend", "treatment"), ["campaign_type"], "label", "treatment")), f"""SELECT campaign_type, {_RATES} FROM scored, (SELECT quantile_cont(usual_spend, [0.05, 0.95]) AS e0 FROM scored WHERE treatment = 0), (SELECT quantile_cont(usual_spend, [0.05, 0.95]) AS e1 FROM scored WHERE treatment = 1)
    WHERE usual_spend BETWEEN greatest(e0[1], e1[1]) AND least(e0[2], e1[2]) GROUP BY campaign_type""", rounded=_R3, **A)
register("product_lookup", a.product_uplift, "SELECT * FROM product_uplift", rounded=_R3, **A)
register("product_summary", a.product_summary, "SELECT product_id, count(*)::BIGINT AS n_campaigns, sum(n_treated_bought)::BIGINT AS n_treated_bought, sum(n_control_bought)::BIGINT AS n_control_bought, sum(n_without_redemption)::BIGINT AS n_without_redemption, sum(n_without_redemption)::DOUBLE / sum(n_treated_bought) AS share_without_redemption FROM product_uplift GROUP BY product_id HAVING sum(n_treated_bought) >= 5", rounded="share_without_redemption", **A)
register("wasted_products", lambda t: d.wasted_products(a.product_uplift(t)), "SELECT product_id, count(*) FILTER (WHERE n_without_redemption > 0)::BIGINT AS n_campaigns, sum(n_without_redemption)::BIGINT AS n_without FROM product_uplift GROUP BY product_id HAVING count(*) FILTER (WHERE n_without_redemption > 0) >= 2 ORDER BY n_without DESC, product_id LIMIT 8", **A)
register("empirical_uplift", lambda t: m.uplift_in(s.scored(t).join(a.clean_control(t).unionByName(t.mailings.select("household_key", "campaign").distinct()), ["household_key", "campaign"], "left_semi"), ["campaign"], "label", "treatment"), f"SELECT campaign, {_RATES} FROM scored WHERE treatment = 1 OR (household_key, campaign) IN (SELECT household_key, campaign FROM control) GROUP BY campaign", rounded=_R3, **A)
register("pool_sizes", a.pool_sizes, "SELECT campaign, count(*)::BIGINT AS n_products, count(*)::DOUBLE / (SELECT count(DISTINCT product_id) FROM products) AS share FROM cprod GROUP BY campaign", rounded="share", **A)
register("campaign_features", a.campaign_features, """SELECT c.campaign, n_products::BIGINT AS n_products, n_coupons::BIGINT AS n_coupons, coalesce(cents, 0)::BIGINT AS population_cents, coalesce(buyers, 0)::BIGINT AS population_buyers FROM (SELECT campaign, count(DISTINCT product_id) AS n_products, count(DISTINCT coupon_upc) AS n_coupons FROM coupons GROUP BY campaign) c
    LEFT JOIN (SELECT k.campaign, sum(sales_cents) AS cents, count(DISTINCT household_key) AS buyers FROM tx JOIN cprod USING (product_id) JOIN campaigns k ON k.campaign = cprod.campaign AND day < start_day AND day >= start_day - 182 GROUP BY k.campaign) p ON p.campaign = c.campaign""", **A)
register("never_seen", lambda t: a.never_seen(t, 20, 2000), """SELECT 'department' AS kind, department AS value, count(*) FILTER (WHERE day > 20)::BIGINT AS n FROM tx JOIN products USING (product_id) WHERE day <= 2000 GROUP BY department HAVING count(*) FILTER (WHERE day <= 20) = 0 AND count(*) FILTER (WHERE day > 20) > 0
    UNION ALL SELECT 'campaign_type', campaign_type, count(*) FILTER (WHERE start_day > 20)::BIGINT FROM campaigns WHERE start_day <= 2000 GROUP BY campaign_type HAVING count(*) FILTER (WHERE start_day <= 20) = 0 AND count(*) FILTER (WHERE start_day > 20) > 0""", **A)
register("unusual_moves", on(lambda x: a.unusual_moves(x.groupBy("campaign", "start_day").agg(F.avg("spend").alias("value")), "value", "start_day", 1.0)), """SELECT campaign, start_day, value, before, move, usual FROM (SELECT *, stddev_samp(move) OVER (ORDER BY start_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM (SELECT campaign, start_day, avg(spend) AS value, lag(avg(spend)) OVER (ORDER BY start_day) AS before,
    avg(spend) - lag(avg(spend)) OVER (ORDER BY start_day) AS move, row_number() OVER (ORDER BY start_day) - 1 AS place FROM scored GROUP BY campaign, start_day)) WHERE place >= 4 AND abs(move) > usual AND abs(move) > 0.1 * abs(before)""", rounded="value before move usual", **A)
_FIFTHS = "SELECT *, floor((row_number() OVER (PARTITION BY campaign ORDER BY usual_spend, household_key) - 1) * 5 / count(*) OVER (PARTITION BY campaign))::BIGINT AS fifth FROM scored"
register("same_habit_auc", on(lambda x: a.same_habit_auc(x, "score", "label", "usual_spend")), """SELECT sum(auc * pos) / sum(pos) AS auc FROM (SELECT sum(pos) AS pos, sum(pos * (2 * below + n - pos))::DOUBLE / (2 * sum(pos) * (sum(n) - sum(pos))) AS auc FROM (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY campaign, fifth ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT campaign, fifth, score AS s, count(*) AS n, sum(label) AS pos FROM fifths GROUP BY ALL)) GROUP BY campaign, fifth HAVING sum(pos) > 0 AND sum(pos) < sum(n) AND min(s) < max(s))""", rounded="auc", **A, fifths=_FIFTHS)
_ONE = "SELECT '{0}' AS \"column\", greatest(auc, 1 - auc) AS auc FROM (SELECT sum(pos * (2 * below + n - pos))::DOUBLE / (2 * sum(pos) * (sum(n) - sum(pos))) AS auc FROM (SELECT *, coalesce(sum(n - pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {0} AS s, count(*) AS n, sum(label) AS pos FROM scored GROUP BY ALL)))"
register("signal_screen", on(lambda x: a.signal_screen(x, ["score", "score_b", "usual_spend"], "label")), " UNION ALL ".join(_ONE.format(c) for c in ("score", "score_b", "usual_spend")), rounded="auc", **A)
register("signal_auc", on(lambda x: a.signal_screen(x, ["score", "usual_spend"], "redeemed")), " UNION ALL ".join(_ONE.replace("sum(label)", "sum(redeemed)").format(c) for c in ("score", "usual_spend")), rounded="auc", **A)
register("leak_alarm", on(lambda x: a.signal_screen(x, ["score", "spend"], "label").withColumn("alarm", F.col("auc") > 0.9)), " UNION ALL ".join(f"SELECT *, auc > 0.9 AS alarm FROM ({_ONE.format(c)})" for c in ("score", "spend")), rounded="auc", **A)
register("depth_table", on(lambda x: a.depth_table(x, ["score", "score_b"], "label")), f"""SELECT ranking, campaign_type, share, sum({_caught('share')}) / sum(pos) AS capture FROM (SELECT *, coalesce(sum(n) OVER w, 0) AS n_above, sum(n) OVER (PARTITION BY ranking, campaign) AS n_all FROM (SELECT ranking, campaign_type, campaign, s, count(*) AS n, sum(label) AS pos FROM (SELECT 'score' AS ranking, *, score AS s FROM scored UNION ALL SELECT 'score_b', *, score_b FROM scored) GROUP BY ALL)
    WINDOW w AS (PARTITION BY ranking, campaign ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS share) GROUP BY ranking, campaign_type, share""", rounded="capture", **A)

# decision table


def table(t):
    x = s.scored(t)
    response = x.where("treatment = 1").select("household_key", "campaign", F.col("score").alias("p_redeem"), F.col("usual_spend").alias("spend_if_redeem"), "redeemed")
    uplift = x.where("campaign_type <> 'A'").select("household_key", "campaign", (F.col("score") - F.col("score_b")).alias("uplift"), F.col("treatment").alias("mailed"), F.col("label").alias("bought"))
    return d.decision_table(response, uplift, t)


D = {**A, "decision": f"""SELECT household_key, campaign, r.p_redeem, r.spend_if_redeem, r.redeemed, u.uplift, u.mailed, u.bought, k.campaign_type, k.start_day, k.end_day, {', '.join('g.' + c for c in LABELS)}, r.p_redeem * r.spend_if_redeem AS expected_revenue, k.end_day - k.start_day + 1 AS length_days, g.household_key IS NOT NULL AS has_demographics
    FROM (SELECT household_key, campaign, score AS p_redeem, usual_spend AS spend_if_redeem, redeemed FROM scored WHERE treatment = 1) r FULL JOIN (SELECT household_key, campaign, score - score_b AS uplift, treatment AS mailed, label AS bought FROM scored WHERE campaign_type <> 'A') u USING (household_key, campaign)
    LEFT JOIN campaigns k USING (campaign) LEFT JOIN demographics g USING (household_key)""", "cats": "SELECT campaign, commodity AS category, count(*)::BIGINT AS products FROM cprod JOIN products USING (product_id) GROUP BY ALL",
    "cat_red": "SELECT household_key, category, count(*)::BIGINT AS redemptions FROM redemptions JOIN (SELECT DISTINCT campaign, coupon_upc, commodity AS category FROM coupons JOIN products USING (product_id)) USING (campaign, coupon_upc) GROUP BY ALL"}
_SUM = "count(DISTINCT household_key)::BIGINT AS households, count(*)::BIGINT AS pairs, avg(p_redeem) AS average, avg(redeemed) AS actual, count(DISTINCT household_key) < 30 AS small_group"
register("decision_table", table, "SELECT * FROM decision", **D)
register("campaign_dates", lambda t: t.campaigns.select("campaign", "campaign_type", "start_day", "end_day", (F.col("end_day") - F.col("start_day") + 1).alias("length_days")), "SELECT *, end_day - start_day + 1 AS length_days FROM campaigns", **D)
register("campaign_categories", d.campaign_categories, "SELECT * FROM cats", **D)
register("category_redemptions", d.category_redemptions, "SELECT * FROM cat_red", **D)
register("q_summary", lambda t: d.summary(d.matching(table(t), "p_redeem", 8, {"income": ["inc1", "inc2"]}), "p_redeem"), f"SELECT {_SUM} FROM decision WHERE campaign = 8 AND p_redeem IS NOT NULL AND income IN ('inc1', 'inc2')", rounded="average actual", **D)
register("q_top", lambda t: d.top(d.matching(table(t), "expected_revenue", 8), "expected_revenue", 20), "SELECT household_key, campaign, expected_revenue, redeemed FROM decision WHERE campaign = 8 AND expected_revenue IS NOT NULL ORDER BY expected_revenue DESC, household_key LIMIT 20", **D)
register("q_top_share", lambda t: d.top(d.matching(table(t), "p_redeem", 8), "p_redeem", share=0.1), "SELECT household_key, campaign, p_redeem, redeemed FROM (SELECT *, row_number() OVER (ORDER BY p_redeem DESC, household_key) AS place, count(*) OVER () AS n FROM decision WHERE campaign = 8 AND p_redeem IS NOT NULL) WHERE place <= ceil(round(n * 0.1, 9))", **D)
register("q_top_reach", lambda t: d.top_reach(d.matching(table(t), "p_redeem", 8), "p_redeem", 20), "SELECT count(*) FILTER (WHERE place <= 20)::BIGINT AS n, sum(p_redeem) FILTER (WHERE place <= 20) AS total, sum(redeemed) FILTER (WHERE place <= 20)::BIGINT AS reached, count(*)::BIGINT AS n_all, sum(redeemed)::BIGINT AS all_redeemed, sum(redeemed) * least(20, count(*))::DOUBLE / count(*) AS at_random FROM (SELECT *, row_number() OVER (ORDER BY p_redeem DESC, household_key) AS place FROM decision WHERE campaign = 8 AND p_redeem IS NOT NULL)", rounded="total at_random", **D)
register("q_by_segment", lambda t: d.by_segment(d.matching(table(t), "p_redeem", 8), "p_redeem", "age"), "SELECT age, count(DISTINCT household_key)::BIGINT AS households, avg(p_redeem) AS average, avg(redeemed) AS actual FROM decision WHERE campaign = 8 AND p_redeem IS NOT NULL AND age IS NOT NULL GROUP BY age", rounded="average actual", **D)
register("q_compare", lambda t: d.compare(table(t), "p_redeem", {"young": {"age": ["age0"]}, "old": {"age": ["age4"]}}), f"SELECT CASE WHEN age = 'age0' THEN 'young' ELSE 'old' END AS \"group\", {_SUM} FROM decision WHERE p_redeem IS NOT NULL AND age IN ('age0', 'age4') GROUP BY 1", rounded="average actual", **D)
register("q_by_category", lambda t: d.by_category(table(t), d.category_redemptions(t), None, {"age": ["age1"]}), """SELECT category, in_group, in_group::DOUBLE / n_group AS share, in_base::DOUBLE / n_base AS base_share, (in_group::DOUBLE / n_group) / (in_base::DOUBLE / n_base) AS times FROM (SELECT category, count(DISTINCT household_key) FILTER (WHERE household_key IN (SELECT household_key FROM decision WHERE age = 'age1'))::BIGINT AS in_group, count(DISTINCT household_key) AS in_base FROM cat_red
    WHERE household_key IN (SELECT household_key FROM decision WHERE has_demographics) GROUP BY category), (SELECT count(DISTINCT household_key) FILTER (WHERE age = 'age1') AS n_group, count(DISTINCT household_key) AS n_base FROM decision WHERE has_demographics) WHERE in_group > 0 ORDER BY in_group DESC, category LIMIT 10""", rounded="share base_share times", **D)
register("q_category_segment", lambda t: d.category_segment(table(t), d.category_redemptions(t), "Brand#1", "age"), "SELECT age, count(*)::BIGINT AS households, avg(CASE WHEN household_key IN (SELECT household_key FROM cat_red WHERE category = 'Brand#1') THEN 1 ELSE 0 END) AS share FROM (SELECT DISTINCT household_key, age FROM decision WHERE age IS NOT NULL) GROUP BY age", rounded="share", **D)
register("q_household", lambda t: d.household(table(t), 3), "SELECT * FROM decision WHERE household_key = 3", **D)
register("q_campaign", lambda t: d.campaign_card(table(t), d.campaign_categories(t), 8, ["p_redeem", "uplift"]), "SELECT campaign, campaign_type, length_days, count(p_redeem)::BIGINT AS n_p_redeem, count(uplift)::BIGINT AS n_uplift, (SELECT count(*) FROM cats WHERE campaign = 8)::BIGINT AS n_categories FROM decision WHERE campaign = 8 GROUP BY ALL", **D)
register("q_find_category", lambda t: d.find_category(d.campaign_categories(t), "#1"), "SELECT DISTINCT category FROM cats WHERE category LIKE '%#1%' ORDER BY category LIMIT 5", **D)
register("q_find_category_close", lambda t: d.find_category(d.campaign_categories(t), "Brend#1"))
register("score_histogram", lambda t: d.score_histogram(table(t), "p_redeem"), "SELECT least(floor((p_redeem - lo) / (hi - lo) * 10), 9)::BIGINT AS bin, count(*)::BIGINT AS n FROM decision, (SELECT min(p_redeem) AS lo, max(p_redeem) AS hi FROM decision) WHERE p_redeem IS NOT NULL GROUP BY 1", **D)
register("population_breakdown", lambda t: d.population_breakdown(table(t), "p_redeem", "income"), "SELECT income, avg(p_redeem) AS average FROM decision WHERE income IS NOT NULL GROUP BY income", rounded="average", **D)
register("top_scores", lambda t: d.top(d.matching(table(t), "p_redeem", 8), "p_redeem", 20), "SELECT household_key, campaign, p_redeem, redeemed FROM decision WHERE campaign = 8 AND p_redeem IS NOT NULL ORDER BY p_redeem DESC, household_key LIMIT 20", **D)
register("dataset_facts", d.dataset_facts, "SELECT campaign_type, count(*)::BIGINT AS mailings, count(DISTINCT household_key)::BIGINT AS households, count(DISTINCT campaign)::BIGINT AS campaigns, count(*) FILTER (WHERE (household_key, campaign) IN (SELECT household_key, campaign FROM redemptions))::BIGINT AS redeemed FROM mailed_pairs JOIN campaigns USING (campaign) GROUP BY campaign_type", **D)
register("campaign_products", d.campaign_products, "SELECT DISTINCT campaign, department, commodity FROM cprod JOIN products USING (product_id)", **D)
register("per_campaign_scores", lambda t: d.per_campaign_scores(table(t), ["p_redeem", "uplift", "expected_revenue"]), "SELECT campaign, avg(p_redeem) AS p_redeem, avg(uplift) AS uplift, avg(expected_revenue) AS expected_revenue FROM decision GROUP BY campaign", rounded="p_redeem uplift expected_revenue", **D)
register("type_departments", d.type_departments, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY campaign_type ORDER BY products DESC, department)::BIGINT AS place FROM (SELECT campaign_type, department, count(DISTINCT product_id)::BIGINT AS products FROM cprod JOIN campaigns USING (campaign) JOIN products USING (product_id) GROUP BY ALL)) WHERE place <= 6", **D)
register("type_scores", lambda t: d.type_scores(table(t), "p_redeem"), "SELECT campaign_type, avg(p_redeem) AS average, count(DISTINCT campaign)::BIGINT AS campaigns FROM decision GROUP BY campaign_type", rounded="average", **D)
register("product_text_search", lambda t: d.product_text_search(t.products, "promo"), "SELECT * FROM products WHERE lower(department || ' ' || commodity || ' ' || brand) LIKE '%promo%'", **D)
register("campaign_mix", lambda t: d.campaign_categories(t).where("campaign = 8").orderBy(F.desc("products"), "category").limit(25), "SELECT * FROM cats WHERE campaign = 8 ORDER BY products DESC, category LIMIT 25", **D)
register("demographic_mix", lambda t: table(t).groupBy("has_demographics").agg(F.median("spend_if_redeem").alias("median_spend"), F.count(F.lit(1)).alias("n")), "SELECT has_demographics, median(spend_if_redeem) AS median_spend, count(*)::BIGINT AS n FROM decision GROUP BY has_demographics", rounded="median_spend", **D)

# outliers and flags, over lines some of which are made odd by a rule of their keys


def odd(t):
    mark = F.col("product_id") + F.col("day")
    lines = t.transactions.withColumn("quantity", F.when(mark % 101 == 0, 0).when(mark % 103 == 0, -F.col("quantity")).otherwise(F.col("quantity"))).withColumn("retail_disc_cents", F.when(mark % 89 == 0, -F.col("retail_disc_cents")).otherwise(F.col("retail_disc_cents")))
    return o.nonmerch_flag(lines, t.products, ("PROMO",), ("Brand#25",))


def flagged(t):
    return o.line_flags(odd(t), stored)


O = {  # noqa: E741
    **D,
    "odd": """SELECT household_key, basket_id, day, week_no, product_id, store_id, CASE WHEN (product_id + day) % 101 = 0 THEN 0 WHEN (product_id + day) % 103 = 0 THEN -quantity ELSE quantity END AS quantity, sales_cents, CASE WHEN (product_id + day) % 89 = 0 THEN -retail_disc_cents ELSE retail_disc_cents END AS retail_disc_cents, coupon_disc_cents,
        (trim(department) = 'PROMO' OR trim(commodity) = 'Brand#25') AS is_non_merchandise, trim(department) = '' AS no_department FROM tx JOIN products USING (product_id)""",
    "vals": " UNION ALL ".join(f"SELECT *, '{n}' AS field, {v} AS value FROM odd WHERE NOT is_non_merchandise AND {w}" for n, w, v in (("quantity", "quantity > 0", "quantity::DOUBLE"), ("sales", "sales_cents > 0", "sales_cents::DOUBLE"), ("unit_price", "quantity > 0 AND sales_cents > 0", "sales_cents::DOUBLE / quantity"), ("retail_disc", "retail_disc_cents < 0", "-retail_disc_cents::DOUBLE"), ("coupon_disc", "coupon_disc_cents < 0", "-coupon_disc_cents::DOUBLE"))),
    "fence": """SELECT field, n::BIGINT AS n_eligible, CASE WHEN q[2] - q[1] > 1e-9 THEN 'iqr_log' ELSE 'percentile' END AS method, CASE WHEN q[2] - q[1] > 1e-9 THEN exp(q[1] - 1.5 * (q[2] - q[1])) ELSE p[2] END AS mild_low, CASE WHEN q[2] - q[1] > 1e-9 THEN exp(q[2] + 1.5 * (q[2] - q[1])) ELSE p[3] END AS mild_high,
        CASE WHEN q[2] - q[1] > 1e-9 THEN exp(q[1] - 3 * (q[2] - q[1])) ELSE p[1] END AS extreme_low, CASE WHEN q[2] - q[1] > 1e-9 THEN exp(q[2] + 3 * (q[2] - q[1])) ELSE p[4] END AS extreme_high, p[4] AS p99_9
        FROM (SELECT field, count(*) AS n, quantile_cont(ln(value), [0.25, 0.75]) AS q, quantile_cont(value, [0.001, 0.01, 0.99, 0.999]) AS p FROM vals GROUP BY field) WHERE n >= 20""",
    "usual": "SELECT product_id, count(*) AS n, median(sales_cents::DOUBLE / quantity) AS unit, median(sales_cents::DOUBLE) AS sales, median(quantity::DOUBLE) AS qty FROM odd WHERE quantity > 0 AND sales_cents > 0 GROUP BY product_id",
    "share_f": "SELECT CASE WHEN count(*) >= 100 THEN q[2] + 1.5 * (q[2] - q[1]) END AS share_fence FROM (SELECT quantile_cont(-retail_disc_cents::DOUBLE / (sales_cents - retail_disc_cents), [0.25, 0.75]) AS q FROM odd WHERE quantity > 0 AND sales_cents > 0 AND retail_disc_cents < -0.5), (SELECT 1 FROM odd WHERE quantity > 0 AND sales_cents > 0 AND retail_disc_cents < -0.5) GROUP BY q",
    "unit_f": "SELECT u[2] + 1.5 * (u[2] - u[1]) AS unit_fence, s[2] + 1.5 * (s[2] - s[1]) AS sales_fence FROM (SELECT quantile_cont(abs(ln(sales_cents::DOUBLE / quantity / unit)), [0.25, 0.75]) AS u, quantile_cont(abs(ln(sales_cents / sales)), [0.25, 0.75]) AS s FROM odd JOIN usual USING (product_id) WHERE quantity > 0 AND sales_cents > 0)",
    "tests": """SELECT o.*, u.n, u.qty, coalesce(retail_disc_cents > 0.5 AND quantity > 0 AND sales_cents + retail_disc_cents > 0 AND retail_disc_cents::DOUBLE / (sales_cents + retail_disc_cents) <= least(share_fence, 1), false) AS disc_typo, quantity <= 0 AND sales_cents > 0.5 AND NOT (retail_disc_cents > 0.5 AND quantity <= 0) AS money,
        coalesce(quantity < 0 AND u.n >= 5 AND abs(ln(sales_cents::DOUBLE / abs(quantity) / unit)) <= unit_fence, false) AS sign_ok, coalesce(quantity = 0 AND u.n >= 5 AND abs(ln(sales_cents / sales)) <= sales_fence, false) AS zero_ok FROM odd o LEFT JOIN usual u USING (product_id), share_f, unit_f""",
    "flagged": """SELECT household_key, basket_id, day, week_no, product_id, store_id, quantity, sales_cents, retail_disc_cents, coupon_disc_cents, is_non_merchandise, no_department, retail_disc_cents > 0.5 AS flag_positive_retail_disc, (retail_disc_cents > 0 AND retail_disc_cents <= 0.5) OR (coupon_disc_cents > 0 AND coupon_disc_cents <= 0.5) AS flag_discount_rounding_noise,
        retail_disc_cents > 0.5 AND quantity <= 0 AS flag_adjustment_line, disc_typo AS flag_discount_sign_typo, retail_disc_cents > 0.5 AND quantity > 0 AND NOT disc_typo AS flag_positive_discount_unexplained, quantity <= 0 AS flag_nonpositive_qty, sales_cents <= 0 AS flag_nonpositive_sales, quantity <= 0 AND sales_cents <= 0 AS flag_zero_line,
        quantity > 0 AND sales_cents <= 0 AS flag_free_item, money AND sign_ok AS flag_qty_sign_typo, money AND zero_ok AS flag_qty_missing_money_ok, money AND NOT sign_ok AND NOT zero_ok AS flag_qty_nonpos_with_sales, quantity <= 0 AND sales_cents > 0 AND sales_cents <= 0.5 AND NOT (retail_disc_cents > 0.5) AS flag_sales_rounding_noise,
        CASE WHEN disc_typo THEN -abs(retail_disc_cents) END AS retail_disc_corrected, CASE WHEN money AND sign_ok THEN abs(quantity) END AS quantity_corrected, CASE WHEN money AND zero_ok THEN qty END AS quantity_imputed, CASE WHEN money AND zero_ok THEN 'product_median' END AS quantity_imputed_source FROM tests""",
}
_LINE = "household_key, basket_id, day, product_id, store_id, quantity, sales_cents"
_lines = _LINE.split(", ")
register("nonmerch_flag", lambda t: odd(t).groupBy("is_non_merchandise", "no_department").agg(F.count(F.lit(1)).alias("n")), "SELECT is_non_merchandise, no_department, count(*)::BIGINT AS n FROM odd GROUP BY ALL", **O)
register("nonmerch_mix", lambda t: o.nonmerch_mix(odd(t), t.products), "SELECT department, commodity, count(*)::BIGINT AS n FROM odd JOIN products USING (product_id) WHERE is_non_merchandise GROUP BY ALL ORDER BY n DESC, department, commodity LIMIT 6", **O)
register("log_iqr_fences", lambda t: o.fences(o.fields(odd(t))), "SELECT * FROM fence", rounded="mild_low mild_high extreme_low extreme_high p99_9", **O)
register("outlier_level", lambda t: (lambda v: o.levels(v, o.fences(v)).groupBy("field", "level_high", "level_low").agg(F.count(F.lit(1)).alias("n")))(o.fields(odd(t))), """SELECT field, (CASE WHEN value > extreme_high THEN 2 WHEN field NOT IN ('retail_disc', 'coupon_disc') AND value > mild_high THEN 1 ELSE 0 END)::BIGINT AS level_high,
    (CASE WHEN field <> 'unit_price' THEN 0 WHEN value < extreme_low THEN 2 WHEN value < mild_low THEN 1 ELSE 0 END)::BIGINT AS level_low, count(*)::BIGINT AS n FROM vals JOIN fence USING (field) GROUP BY ALL""", **O)
register("outlier_fields", lambda t: o.fields(odd(t)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")), "SELECT field, count(*)::BIGINT AS n, min(value) AS least, max(value) AS most FROM vals GROUP BY field", rounded="least most", **O)
register("outlier_sensitivity", lambda t: (lambda v: o.sensitivity(v, o.fences(v), 40))(o.fields(odd(t))), " UNION ALL ".join(f"SELECT field, '{n}' AS rule, count(*) FILTER (WHERE {c})::BIGINT AS n_flagged, count(*)::BIGINT AS n_eligible FROM vals JOIN fence USING (field) GROUP BY field" for n, c in (("mild_high", "value > mild_high"), ("extreme_high", "value > extreme_high"), ("mild_low", "value < mild_low"), ("extreme_low", "value < extreme_low"), ("p99_9", "value > p99_9"), ("old_fixed", "field = 'quantity' AND value > 40"))), **O)
register("tx_flags", lambda t: flagged(t).select(*_lines, *[f"flag_{x}" for x in ("positive_retail_disc", "discount_rounding_noise", "adjustment_line", "nonpositive_qty", "nonpositive_sales", "zero_line", "free_item", "sales_rounding_noise")]), f"SELECT {_LINE}, flag_positive_retail_disc, flag_discount_rounding_noise, flag_adjustment_line, flag_nonpositive_qty, flag_nonpositive_sales, flag_zero_line, flag_free_item, flag_sales_rounding_noise FROM flagged", **O)
register("disc_sign_typo", lambda t: flagged(t).where("flag_positive_retail_disc").select(*_lines, "flag_discount_sign_typo", "flag_positive_discount_unexplained"), f"SELECT {_LINE}, flag_discount_sign_typo, flag_positive_discount_unexplained FROM flagged WHERE flag_positive_retail_disc", **O)
register("qty_typo", lambda t: flagged(t).where("flag_nonpositive_qty").select(*_lines, "flag_qty_sign_typo", "flag_qty_missing_money_ok", "flag_qty_nonpos_with_sales"), f"SELECT {_LINE}, flag_qty_sign_typo, flag_qty_missing_money_ok, flag_qty_nonpos_with_sales FROM flagged WHERE flag_nonpositive_qty", **O)
register("corrected_values", lambda t: flagged(t).where("flag_nonpositive_qty or flag_positive_retail_disc").select(*_lines, "retail_disc_corrected", "quantity_corrected", "quantity_imputed", "quantity_imputed_source"), f"SELECT {_LINE}, retail_disc_corrected, quantity_corrected, quantity_imputed, quantity_imputed_source FROM flagged WHERE flag_nonpositive_qty OR flag_positive_retail_disc", **O)
register("flag_stats", lambda t: o.flag_stats(flagged(t)), " UNION ALL ".join(f"SELECT 'flag_{x}' AS flag, count(*) FILTER (WHERE flag_{x})::BIGINT AS n FROM flagged" for x in ("positive_retail_disc", "discount_rounding_noise", "adjustment_line", "discount_sign_typo", "positive_discount_unexplained", "nonpositive_qty", "nonpositive_sales", "zero_line", "free_item", "qty_sign_typo", "qty_missing_money_ok", "qty_nonpos_with_sales", "sales_rounding_noise")), **O)
