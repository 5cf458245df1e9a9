"""Queries of splits, ranking and uplift metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decision, splits
from ..operators import metrics as m
from . import scored as s
from .catalog import register

SHARES = ", ".join(f"{x}::DOUBLE" for x in m.SHARES)


def _ranks(by: str, source: str = "scored", score: str = "score", label: str = "label") -> str:
    over = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}s, n, pos, coalesce(sum(n) OVER ({over} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_above, coalesce(sum(pos) OVER ({over} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above,
        sum(n) OVER ({over}) AS n_all, sum(pos) OVER ({over}) AS pos_all FROM (SELECT {lead}{score} AS s, count(*) AS n, sum({label}) AS pos FROM {source} GROUP BY ALL)"""


def _caught(share: str) -> str:
    return f"pos * greatest(0::DOUBLE, least(n::DOUBLE, greatest(1::DOUBLE, round_even(n_all * {share}, 0)) - n_above)) / n"


M = {**s.SCORED, "pooled": _ranks(""), "within": _ranks("campaign"), "mailed_rows": "SELECT * FROM scored WHERE treatment = 1", "within_mailed": _ranks("campaign", "mailed_rows", label="redeemed")}
_AUC = "sum(pos * (2 * (n_all - n_above - n - (pos_all - pos_above - pos)) + n - pos))::DOUBLE / (2 * max(pos_all) * (max(n_all) - max(pos_all)))"
_AUCS = f"SELECT campaign, max(n_all)::BIGINT AS n, max(pos_all)::BIGINT AS pos, CASE WHEN max(pos_all) > 0 AND max(pos_all) < max(n_all) THEN {_AUC} END AS auc FROM within GROUP BY campaign"


def on(fn):
    return lambda t: fn(s.scored(t))


register("top_share_capture", on(lambda d: m.capture(d, "score", "label")), f"SELECT sum({_caught('0.2::DOUBLE')}) / sum(pos) AS capture FROM pooled", rounded="capture", **M)
register("within_capture", on(lambda d: m.capture(d, "score", "label", by=["campaign"])), f"SELECT sum({_caught('0.2::DOUBLE')}) / sum(pos) AS capture FROM within", rounded="capture", **M)
_CURVE = f"SELECT share, sum({_caught('share')}) / sum(pos) AS capture FROM within, (SELECT unnest([{SHARES}]) AS share) GROUP BY share"
register("within_capture_curve", on(lambda d: m.capture_curve(d, "score", "label", ["campaign"])), _CURVE, rounded="capture", **M)
register("within_capture_avg", on(lambda d: m.capture_average(d, "score", "label", ["campaign"])), f"SELECT avg(capture) AS capture FROM ({_CURVE})", rounded="capture", **M)
_RANDOM = "SELECT share, sum(pos * greatest(1::DOUBLE, round_even(n * share, 0)) / n) / sum(pos) AS capture FROM (SELECT campaign, count(*) AS n, sum(label) AS pos FROM scored GROUP BY campaign), (SELECT unnest([{}]) AS share) GROUP BY share"
register("random_capture", on(lambda d: m.random_capture(d, "label", ["campaign"])), _RANDOM.format("0.2::DOUBLE"), rounded="capture", **M)
register("random_capture_avg", on(lambda d: m.random_capture(d, "label", ["campaign"], m.SHARES).agg(F.avg("capture").alias("capture"))), f"SELECT avg(capture) AS capture FROM ({_RANDOM.format(SHARES)})", rounded="capture", **M)
register("campaign_auc", on(lambda d: m.auc(d, "score", "label", ["campaign"])), _AUCS, rounded="auc", **M)
register("within_auc", on(lambda d: m.within_auc(d, "score", "label", ["campaign"])), f"SELECT sum(auc * n) / sum(n) AS auc FROM ({_AUCS}) WHERE auc IS NOT NULL", rounded="auc", **M)
register("pooled_auc", on(lambda d: m.auc(d, "score", "label")), f"SELECT max(n_all)::BIGINT AS n, max(pos_all)::BIGINT AS pos, {_AUC} AS auc FROM pooled", rounded="auc", **M)
register("pr_auc", on(lambda d: m.average_precision(d, "score", "label")), "SELECT sum(pos * ((pos_above + pos)::DOUBLE / (n_above + n))) / max(pos_all) AS average_precision FROM pooled", rounded="average_precision", **M)
register("capture_summary", on(lambda d: m.capture_summary(d, "score", "label")), f"""SELECT g AS "group", sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, sum({_caught('0.2::DOUBLE')}) / sum(pos) AS capture
    FROM (SELECT *, unnest(['all', CASE WHEN campaign IN (SELECT campaign FROM campaigns WHERE campaign_type = 'A') THEN 'A' ELSE 'BC' END]) AS g FROM within) GROUP BY g""", rounded="capture", **M)
_BIN = lambda bins, column="score": f"SELECT d.*, len(list_filter(e.edges, lambda x: d.{column} > x))::BIGINT AS bin FROM scored d, (SELECT quantile_cont({column}, [{', '.join(f'{i / bins}' for i in range(1, bins))}]) AS edges FROM scored) e"
register("calibration_deciles", on(lambda d: m.calibration(d, "score", "label")), "SELECT bin, count(*)::BIGINT AS n, avg(score) AS predicted, avg(label) AS actual FROM binned GROUP BY bin", rounded="predicted actual", **M, binned=_BIN(10))
register("quintile_check", on(lambda d: m.calibration(d, "score_b", "label", 5)), "SELECT bin, count(*)::BIGINT AS n, avg(score_b) AS predicted, avg(label) AS actual FROM binned GROUP BY bin", rounded="predicted actual", **M, binned=_BIN(5, "score_b"))
register("brier", on(lambda d: m.brier(d, "score", "label")), "SELECT avg((score - label) * (score - label)) AS brier, avg(label) * (1 - avg(label)) AS base_brier FROM scored", rounded="brier base_brier", **M)
_PER = "SELECT campaign, sum(score) AS expected, sum(score * (1 - score)) AS chance_var, sum(label)::DOUBLE AS actual FROM scored GROUP BY campaign"
register("expected_by_campaign", on(lambda d: m.expected_by_campaign(d, "score", "label")), _PER, rounded="expected chance_var", **M)
register("totals_by_campaign", on(lambda d: d.where("treatment = 1").groupBy("campaign").agg(F.sum("usual_spend").alias("predicted"), F.sum("spend").alias("actual"))), "SELECT campaign, sum(usual_spend) AS predicted, sum(spend) AS actual FROM mailed_rows GROUP BY campaign", rounded="predicted actual", **M)
register("spend_errors", on(lambda d: m.errors(d.where("redeemed = 1"), "usual_spend", "spend")), "SELECT avg(abs(usual_spend - spend)) AS mae, median(abs(usual_spend - spend)) AS median_ae, sum(usual_spend) / sum(spend) AS total_ratio FROM scored WHERE redeemed = 1", rounded="mae median_ae total_ratio", **M)
register("total_ratio_check", on(lambda d: m.errors(d.where("redeemed = 1"), "usual_spend", "spend").select("total_ratio", F.col("total_ratio").between(0.85, 1.15).alias("within_15"))), "SELECT r AS total_ratio, r BETWEEN 0.85 AND 1.15 AS within_15 FROM (SELECT sum(usual_spend) / sum(spend) AS r FROM scored WHERE redeemed = 1)", rounded="total_ratio", **M)
_AVG_RANK = "SELECT *, rank() OVER (PARTITION BY campaign ORDER BY {0}) + (count(*) OVER (PARTITION BY campaign, {0}) - 1) / 2.0::DOUBLE AS rank_{0} FROM {1}"
register("rank_rho", on(lambda d: m.rank_correlation(d, "score", "spend", ["campaign"])), "SELECT campaign, corr(rank_score, rank_spend) AS rho FROM both_ranks GROUP BY campaign", rounded="rho", **M, one_rank=_AVG_RANK.format("score", "scored"), both_ranks=_AVG_RANK.format("spend", "one_rank"))
# row by row: every row's place, its share of its ties, and the trapezoids between places
_ARMS = "SELECT {k} AS campaign, score AS s, count(*)::BIGINT AS n, sum({w} * treatment * label)::DOUBLE AS yt, sum({w} * (1 - treatment) * label)::DOUBLE AS yc, sum({w} * treatment)::DOUBLE AS wt, sum({w} * (1 - treatment))::DOUBLE AS wc FROM {f} GROUP BY ALL"
_CURVE_OF = {
    "tied": """SELECT *, sum(n) OVER e AS n_all, sum(wt) OVER e AS treated, sum(wc) OVER e AS control, sum(n) OVER o - n AS above, sum(yt) OVER o - yt AS yt_above, sum(yc) OVER o - yc AS yc_above FROM arms
        WINDOW e AS (PARTITION BY campaign), o AS (PARTITION BY campaign ORDER BY s DESC ROWS UNBOUNDED PRECEDING)""",
    "lifted": "SELECT *, yt - yc * treated / control AS step, yt_above - yc_above * treated / control AS start FROM tied WHERE treated > 0 AND control > 0",
}
_AREA = {
    "places": "SELECT campaign, n_all, treated, start, step, n, above, unnest(range(above::BIGINT + 1, (above + n)::BIGINT + 1)) AS k FROM lifted",
    "heights": "SELECT campaign, n_all, treated, k, start + step * (k - above) / n AS q FROM places",
    "over_line": "SELECT campaign, treated, k, q - k / n_all * max(q) FILTER (WHERE k = n_all) OVER (PARTITION BY campaign) AS g, n_all FROM heights",
    "areas": "SELECT campaign, coalesce(sum((g + before) / 2 / n_all), 0) AS qini, max(treated)::BIGINT AS treated FROM (SELECT *, lag(g) OVER (PARTITION BY campaign ORDER BY k) AS before FROM over_line) GROUP BY campaign",
}
_GRID = {
    "depths": "SELECT campaign, treated, i, start + step * (ceil(i * n_all / 100::DECIMAL(9, 2)) - above) / n AS q FROM lifted, range(1, 101) t(i) WHERE ceil(i * n_all / 100::DECIMAL(9, 2)) > above AND ceil(i * n_all / 100::DECIMAL(9, 2)) <= above + n",
    "added": "SELECT i, sum(q) AS q FROM depths GROUP BY i UNION ALL SELECT 0, 0",
    "grid_area": "SELECT sum((g + before) / 2 * 0.01) AS area FROM (SELECT g, lag(g) OVER (ORDER BY i) AS before FROM (SELECT i, q - i / 100.0::DOUBLE * (SELECT q FROM added WHERE i = 100) AS g FROM added))",
    "answer": "SELECT area / (SELECT sum(treated) FROM (SELECT DISTINCT campaign, treated FROM lifted)) AS qini FROM grid_area",
}
register("campaign_qini", on(lambda d: m.qini(d, "score", "label", "treatment", ["campaign"])), "SELECT * FROM areas", rounded="qini", **M, arms=_ARMS.format(k="campaign", w="1", f="scored"), **_CURVE_OF, **_AREA)
register("pooled_qini", on(lambda d: m.qini(d.withColumn("every", F.lit(0)), "score", "label", "treatment", ["every"]).select("qini", "treated")), "SELECT qini, treated FROM areas", rounded="qini", **M, arms=_ARMS.format(k="0", w="1", f="scored"), **_CURVE_OF, **_AREA)
register("stratified_qini", on(lambda d: m.stratified_qini(d, "score", "label", "treatment")), "SELECT * FROM answer", rounded="qini", **M, arms=_ARMS.format(k="campaign", w="1", f="scored"), **_CURVE_OF, **_GRID)
register("weighted_qini", on(lambda d: m.stratified_qini(m.ipw(d, "propensity", "treatment"), "score", "label", "treatment", weighted=True)), "SELECT * FROM answer", rounded="qini", **M, arms=_ARMS.format(k="campaign", w="ipw_weight", f="(SELECT * FROM weighted WHERE in_overlap)"), **_CURVE_OF, **_GRID)
_RATES = "count(*)::BIGINT AS n, count(*) FILTER (WHERE treatment = 1)::BIGINT AS n_treated, avg(label) FILTER (WHERE treatment = 1) AS treated_rate, avg(label) FILTER (WHERE treatment <> 1) AS control_rate, avg(label) FILTER (WHERE treatment = 1) - avg(label) FILTER (WHERE treatment <> 1) AS uplift"
register("uplift_extremes", on(lambda d: m.uplift_extremes(d, "score", "label", "treatment")), f"SELECT bin, {_RATES} FROM binned WHERE bin IN (0, 4) GROUP BY bin", rounded="treated_rate control_rate uplift", **M, binned=_BIN(5))
register("ipw_overlap", on(lambda d: m.ipw(d, "propensity", "treatment").select("household_key", "campaign", "ipw_weight", "in_overlap")), "SELECT household_key, campaign, ipw_weight, in_overlap FROM weighted", rounded="ipw_weight", **M)
_BAL = "SELECT '{c}' AS covariate, campaign, abs(sum({c} * ipw_weight * treatment) / sum(ipw_weight * treatment) - sum({c} * ipw_weight * (1 - treatment)) / sum(ipw_weight * (1 - treatment))) AS apart, var_samp({c}) FILTER (treatment = 1) + var_samp({c}) FILTER (treatment = 0) AS v2 FROM weighted GROUP BY campaign HAVING count_if(treatment = 1) >= 20 AND count_if(treatment = 0) > 0"
register("balance", on(lambda d: m.balance(m.ipw(d, "propensity", "treatment"), ["usual_spend", "score_b"], "ipw_weight", "treatment")), f"SELECT covariate, avg(if(v2 > 0, apart / sqrt(v2 / 2), 0)) AS smd FROM ({_BAL.format(c='usual_spend')} UNION ALL {_BAL.format(c='score_b')}) GROUP BY covariate", rounded="smd", **M)
register("att_check", on(lambda d: m.att_check(m.ipw(d, "propensity", "treatment"), "score", "label", "treatment")), """SELECT predicted, t AS treated_rate, c AS control_rate, t - c AS att, if(t > 0 AND c > 0 AND t <> c, r + sqrt(r * r - r), NULL) AS e_value
    FROM (SELECT *, if(t > c, t / c, c / t) AS r FROM (SELECT avg(score) FILTER (treatment = 1) AS predicted, avg(label) FILTER (treatment = 1) AS t, sum(propensity / (1 - propensity) * label) FILTER (treatment = 0) / sum(propensity / (1 - propensity)) FILTER (treatment = 0) AS c FROM weighted WHERE in_overlap))""", rounded="predicted treated_rate control_rate att e_value", **M)
register("forecast_range", lambda t: m.forecast_range(m.expected_by_campaign(s.scored(t), "score", "label").join(t.campaigns.select("campaign", "start_day", "end_day"), "campaign")), """SELECT campaign, expected, chance_var, actual, phi, expected - 1.96 * sqrt(chance_var * phi) AS low, expected + 1.96 * sqrt(chance_var * phi) AS high, abs(actual - expected) <= 1.96 * sqrt(chance_var * phi) AS covered
    FROM (SELECT a.campaign, a.expected, a.chance_var, a.actual, greatest(1, coalesce(avg((b.actual - b.expected) * (b.actual - b.expected) / b.chance_var), 1)) AS phi FROM per JOIN campaigns k USING (campaign) JOIN per a USING (campaign) LEFT JOIN (SELECT per.*, end_day FROM per JOIN campaigns USING (campaign)) b ON b.end_day < k.start_day - 7 GROUP BY ALL)""", rounded="expected chance_var phi low high", **M, per=_PER)
register("newest_campaign", lambda t: m.newest_group(m.auc(s.scored(t), "score", "label", ["campaign"]).where("auc is not null").join(t.campaigns.select("campaign", "start_day"), "campaign").select("campaign", "start_day", "auc"), "auc", "start_day"), f"""SELECT campaign, start_day, auc, mean, sd, abs(auc - mean) <= 2 * sd AS usual FROM (SELECT campaign, start_day, auc, avg(auc) OVER w AS mean, stddev_samp(auc) OVER w AS sd, row_number() OVER (ORDER BY start_day DESC) AS place
    FROM ({_AUCS}) JOIN campaigns USING (campaign) WHERE auc IS NOT NULL WINDOW w AS (ORDER BY start_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE place = 1""", rounded="auc mean sd", **M)
register("no_skill", on(lambda d: d.where("redeemed = 1").crossJoin(F.broadcast(d.where("redeemed = 1").agg(F.avg("spend").alias("mean")))).agg(F.avg(F.abs(F.col("spend") - F.col("mean"))).alias("mae_of_mean"))), "SELECT avg(abs(spend - (SELECT avg(spend) FROM scored WHERE redeemed = 1))) AS mae_of_mean FROM scored WHERE redeemed = 1", rounded="mae_of_mean", **M)


def _long(d):
    one = lambda name, score, chosen: d.where("treatment = 1").select("household_key", "campaign", F.lit(name).alias("candidate_id"), F.col(score).alias("score"), (F.col("household_key") % 2 == chosen).alias("chosen"))
    return one("a", "score", 0).unionByName(one("b", "score_b", 1))


_LONG = "SELECT household_key, campaign, 'a' AS candidate_id, score, household_key % 2 = 0 AS chosen FROM mailed_rows UNION ALL SELECT household_key, campaign, 'b', score_b, household_key % 2 = 1 FROM mailed_rows"
register("wide_predictions", on(lambda d: m.wide(_long(d), ["household_key", "campaign"], ["a", "b"])), "SELECT household_key, campaign, score AS a, score_b AS b FROM mailed_rows", **M)
register("in_use_rows", on(lambda d: decision.in_use_rows(_long(d).withColumns({"is_default": F.col("candidate_id") == "a", "locked": F.lit(False)})).select("household_key", "campaign", "candidate_id", "score")), "SELECT household_key, campaign, 'a' AS candidate_id, score FROM mailed_rows", **M)
register("contract_checks", on(lambda d: m.contract(_long(d))), """SELECT 'blank' AS "check", count(*) FILTER (WHERE score IS NULL)::BIGINT AS n_bad FROM long UNION ALL SELECT 'repeated', (SELECT count(*) FROM (SELECT 1 FROM long GROUP BY household_key, campaign, candidate_id HAVING count(*) > 1))
    UNION ALL SELECT 'not_one_choice', (SELECT count(*) FROM (SELECT 1 FROM long GROUP BY household_key, campaign HAVING count(*) FILTER (WHERE chosen) <> 1))""", **M, long=_LONG)

# draws: multiplicities from the same digests; rankings of drawn rows by sums of multiplicities
_DRAWN = """SELECT *, list_count(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253], lambda x: u >= x))::BIGINT AS w
    FROM (SELECT s.*, rep, ('0x' || substr(md5('{seed}|' || rep || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {rows} s, range(1, {reps} + 1) r(rep))"""
_KEYS = "'|' || household_key"
_OF_REPS = {
    "sides": "SELECT rep, campaign, w, label, 'a' AS side, score AS s FROM drawn WHERE w > 0 UNION ALL SELECT rep, campaign, w, label, 'b', score_b FROM drawn WHERE w > 0",
    "steps": """SELECT *, sum(n) OVER o - n AS n_above, sum(pos) OVER o - pos AS pos_above, sum(n) OVER e AS n_all, sum(pos) OVER e AS pos_all FROM (SELECT rep, side, campaign, s, sum(w) AS n, sum(w * label) AS pos FROM sides GROUP BY ALL)
        WINDOW e AS (PARTITION BY rep, side, campaign), o AS (PARTITION BY rep, side, campaign ORDER BY s DESC ROWS UNBOUNDED PRECEDING)""",
    "areas_of": f"SELECT rep, side, campaign, max(n_all) AS n, if(max(pos_all) > 0 AND max(pos_all) < max(n_all), {_AUC}, NULL) AS auc FROM steps GROUP BY rep, side, campaign",
    "shares_of": f"SELECT rep, side, share, sum({_caught('share')}) / sum(pos) AS capture FROM steps, (SELECT unnest([{SHARES}]) AS share) GROUP BY rep, side, share",
    "values_of": """SELECT rep, side, max(capture) FILTER (share = 0.2::DOUBLE) AS capture, avg(capture) AS capture_avg, any_value(auc) AS auc FROM shares_of JOIN (SELECT rep, side, sum(auc * n) FILTER (auc IS NOT NULL) / sum(n) FILTER (auc IS NOT NULL) AS auc FROM areas_of GROUP BY ALL) USING (rep, side) GROUP BY rep, side""",
    "gaps_of": "SELECT a.rep, a.capture - b.capture AS capture, a.capture_avg - b.capture_avg AS capture_avg, a.auc - b.auc AS auc, a.capture AS ca, b.capture AS cb FROM values_of a JOIN values_of b ON a.rep = b.rep AND a.side = 'a' AND b.side = 'b'",
}
# the rows themselves are draw 0, in which each counts once
_WITH_POINT = lambda seed, reps: f"SELECT * FROM ({_DRAWN.format(seed=seed, reps=reps, key=_KEYS, rows='scored')}) UNION ALL SELECT *, 0 AS rep, 0::DOUBLE AS u, 1 AS w FROM scored"
_Q = "quantile_cont({0}, 0.025) FILTER (rep > 0) AS {1}, quantile_cont({0}, 0.975) FILTER (rep > 0) AS {2}"
register("measure_gaps", on(lambda d: m.measure_gaps(d, "score", "score_b", "label", 20, 3)), " UNION ALL ".join(f"SELECT '{c}' AS measure, gap, spread, gap / spread AS gap_over_spread, low, high FROM (SELECT max({c}) FILTER (rep = 0) AS gap, stddev_pop({c}) FILTER (rep > 0) AS spread, {_Q.format(c, 'low', 'high')} FROM gaps_of)" for c in m.MEASURES),
         rounded="gap spread gap_over_spread low high", **M, drawn=_WITH_POINT(3, 20), **_OF_REPS)
_HALF = "SELECT campaign, if(row_number() OVER (ORDER BY start_day, campaign) <= (SELECT count(*) FROM campaigns) // 2 + 1, 'early', 'late') AS half FROM campaigns"
register("paired_gap", on(lambda d: m.paired_gap(d, "score", "score_b", "label", 20, 7)), f"""SELECT max(auc) FILTER (rep = 0) AS auc_gap, max(capture) FILTER (rep = 0) AS capture_gap, {_Q.format('auc', 'auc_low', 'auc_high')}, {_Q.format('capture', 'capture_low', 'capture_high')},
    (SELECT count_if(a.auc > b.auc) FROM areas_of a JOIN areas_of b USING (rep, campaign) WHERE rep = 0 AND a.side = 'a' AND b.side = 'b')::BIGINT AS campaigns_better, (SELECT count(auc) FROM areas_of WHERE rep = 0 AND side = 'a')::BIGINT AS campaigns,
    {', '.join(f"(SELECT sum(auc * n) FILTER (side = 'a') / sum(n) FILTER (side = 'a') - sum(auc * n) FILTER (side = 'b') / sum(n) FILTER (side = 'b') FROM areas_of JOIN halves USING (campaign) WHERE rep = 0 AND auc IS NOT NULL AND half = '{h}') AS auc_gap_{h}" for h in ('early', 'late'))} FROM gaps_of""",
         rounded="auc_gap capture_gap auc_low auc_high capture_low capture_high auc_gap_early auc_gap_late", **M, halves=_HALF, drawn=_WITH_POINT(7, 20), **_OF_REPS)
_VERDICT = "SELECT *, CASE WHEN gap_low > 0 THEN 'pass' WHEN gap_high < 0 THEN 'fail' ELSE 'inconclusive' END AS verdict FROM (SELECT " + ", ".join(_Q.format(c, f"{n}_low", f"{n}_high") for c, n in (("ca", "capture_score"), ("cb", "capture_score_b"), ("capture", "gap"))) + ", stddev_pop(capture) AS gap_sd FROM gaps_of)"
_VERDICT_COLUMNS = "capture_score_low capture_score_high capture_score_b_low capture_score_b_high gap_low gap_high gap_sd"
register("cluster_bootstrap", on(lambda d: m.bootstrap_capture(d.where("treatment = 1"), "score", "score_b", "label", ["household_key"], 50)), _VERDICT, rounded=_VERDICT_COLUMNS, **M, drawn=_DRAWN.format(seed=1, reps=50, key=_KEYS, rows="mailed_rows"), **_OF_REPS)
register("bootstrap_capture", on(lambda d: m.bootstrap_capture(d.where("treatment = 1"), "score", "score_b", "label", ["household_key", "campaign"])), _VERDICT, rounded=_VERDICT_COLUMNS, **M, drawn=_DRAWN.format(seed=1, reps=300, key=_KEYS + " || '|' || campaign", rows="mailed_rows"), **_OF_REPS)
register("campaign_bootstrap", on(lambda d: m.campaign_bootstrap(d.where("treatment = 1").withColumn("flat", F.lit(20.0)), "usual_spend", "flat", "spend", 1000, 0)), """SELECT (SELECT avg(abs(usual_spend - spend)) - avg(abs(20.0::DOUBLE - spend)) FROM mailed_rows) AS diff, quantile_cont(d, 0.025) AS ci_low, quantile_cont(d, 0.975) AS ci_high, avg((d < 0)::INT) AS share_better
    FROM (SELECT rep, sum(w * (e - f)) / sum(w * n) AS d FROM drawn WHERE w > 0 GROUP BY rep)""", rounded="diff ci_low ci_high share_better", **M, per_campaign="SELECT campaign, sum(abs(usual_spend - spend)) AS e, sum(abs(20.0::DOUBLE - spend)) AS f, count(*) AS n FROM mailed_rows GROUP BY campaign", drawn=_DRAWN.format(seed=0, reps=1000, key="'|' || campaign", rows="per_campaign"))  # fmt: skip

CAL = {**M, "folds": "SELECT a.campaign AS test_campaign, a.start_day - 7 AS cutoff_day, b.campaign AS train_campaign, b.campaign_type AS train_type FROM campaigns a JOIN campaigns b ON b.end_day < a.start_day - 7 WHERE a.start_day >= 1000"}
_folds = lambda t: splits.forward_folds(t.campaigns, 1000, 7)
register("split_70_30", lambda t: splits.split_70_30(t.campaigns), "SELECT campaign, CASE WHEN row_number() OVER (ORDER BY start_day, campaign) <= floor(0.7 * (SELECT count(*) FROM campaigns)) THEN 'train' ELSE 'test' END AS part FROM campaigns", **M)
register("forward_folds", _folds, "SELECT * FROM folds", **CAL)
register("fold_sizes", lambda t: splits.fold_sizes(_folds(t)), "SELECT test_campaign, cutoff_day, count(*)::BIGINT AS n_train, count(*) FILTER (WHERE train_type = 'A')::BIGINT AS n_train_type_a FROM folds GROUP BY ALL", **CAL)
register("walk_forward", lambda t: splits.walk_forward(t.campaigns, t.redemptions, 100), "SELECT a.campaign AS test_campaign, sum(n)::BIGINT AS n_train_rows FROM campaigns a JOIN campaigns b ON b.start_day < a.start_day JOIN (SELECT campaign, count(*) AS n FROM redemptions GROUP BY ALL) r ON r.campaign = b.campaign GROUP BY ALL HAVING sum(n) >= 100", **M)
register("inner_folds", lambda t: splits.inner_folds(_folds(t), t.campaigns), "SELECT test_campaign, train_campaign AS inner_campaign FROM (SELECT f.*, row_number() OVER (PARTITION BY test_campaign ORDER BY k.start_day DESC, train_campaign DESC) AS place FROM folds f JOIN campaigns k ON k.campaign = f.train_campaign) WHERE place <= 4", **CAL)
register("outer_folds", lambda t: splits.outer_folds(_folds(t), s.scored(t).where("treatment = 1").select("campaign", F.col("redeemed").alias("label")), 200, 10), """SELECT test_campaign, cutoff_day, n_rows::BIGINT AS n_rows, n_positives::BIGINT AS n_positives, row_number() OVER (ORDER BY cutoff_day DESC, test_campaign DESC) <= 2 AS locked
    FROM (SELECT test_campaign, cutoff_day, sum(n) AS n_rows, sum(pos) AS n_positives FROM folds JOIN (SELECT campaign, count(*) AS n, sum(redeemed) AS pos FROM mailed_rows GROUP BY ALL) r ON r.campaign = train_campaign GROUP BY ALL) WHERE n_rows >= 200 AND n_positives >= 10""", **CAL)
register("asof_calendar", lambda t: splits.asof_calendar(t.campaigns, 1500), "SELECT count(*) FILTER (WHERE end_day < 1500)::BIGINT AS finished, count(*) FILTER (WHERE end_day >= 1500 AND start_day <= 1500)::BIGINT AS running, count(*) FILTER (WHERE start_day > 1500)::BIGINT AS not_started, (SELECT campaign FROM campaigns WHERE end_day < 1500 ORDER BY end_day DESC, campaign DESC LIMIT 1) AS newest_finished FROM campaigns", **M)
register("newly_finished", lambda t: splits.newly_finished(t.campaigns, 1200, 1500), "SELECT campaign, end_day FROM campaigns WHERE end_day >= 1200 AND end_day < 1500", **M)
register("asof_tables", lambda t: splits.asof(s.scored(t), t.campaigns, 1500).select("household_key", "campaign", "label"), "SELECT household_key, campaign, label FROM scored WHERE end_day < 1500", **M)
register("type_flags", lambda t: splits.type_flags(t.campaigns).select("campaign", "is_type_a", "is_type_b"), "SELECT campaign, (campaign_type = 'A')::BIGINT AS is_type_a, (campaign_type = 'B')::BIGINT AS is_type_b FROM campaigns", **M)
register("fill_blanks", lambda t: splits.fill_blanks(s.scored(t).select("household_key", "campaign", F.when(F.col("redeemed") == 1, F.col("spend")).alias("spend")), {"spend": {"not_redeemed"}}, {"not_redeemed"}), "SELECT household_key, campaign, CASE WHEN redeemed = 1 THEN spend ELSE 0 END AS spend FROM scored", **M)
