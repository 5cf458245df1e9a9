"""A scored table over the bound tables, for metrics, analyses and questions: real outcomes, and scores that are fixed functions of the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import outcomes, spine
from ..schema import Tables
from .queries_features import OUTCOMES


def scored(t: Tables) -> DataFrame:
    k, c = F.col("household_key"), F.col("campaign")
    spend = outcomes.buys(t).groupBy("household_key", "campaign").agg(F.sum("cents").alias("cents"))
    part = lambda a, b, n: ((k * a + c * b) % n).cast("double")
    return spine.redeemed(t).join(spend, ["household_key", "campaign"], "left").select(
        "household_key", "campaign", "campaign_type", "start_day", "end_day", "duration_days", F.col("mailed_flag").alias("treatment"), F.col("redeemed_flag").alias("redeemed"), F.col("cents").isNotNull().cast("long").alias("label"),
        (F.coalesce("cents", F.lit(0)) / 100).alias("spend"), (part(37, 101, 97) / 97).alias("score"), (part(53, 29, 89) / 89).alias("score_b"), (0.02 + part(13, 7, 97) / 100).alias("propensity"), (part(17, 3, 5000) / 100).alias("usual_spend"),
    )


SCORED = {
    **OUTCOMES,
    "scored": """SELECT s.household_key, s.campaign, s.campaign_type, s.start_day, s.end_day, s.duration_days, s.mailed_flag AS treatment, s.redeemed_flag AS redeemed, (CASE WHEN b.cents IS NULL THEN 0 ELSE 1 END)::BIGINT AS label, coalesce(b.cents, 0) / 100::DOUBLE AS spend,
        ((household_key * 37 + campaign * 101) % 97)::DOUBLE / 97::DOUBLE AS score, ((household_key * 53 + campaign * 29) % 89)::DOUBLE / 89::DOUBLE AS score_b, 0.02::DOUBLE + ((household_key * 13 + campaign * 7) % 97)::DOUBLE / 100::DOUBLE AS propensity, ((household_key * 17 + campaign * 3) % 5000)::DOUBLE / 100::DOUBLE AS usual_spend
        FROM spine s LEFT JOIN (SELECT household_key, campaign, sum(sales_cents) AS cents FROM window_lines GROUP BY ALL) b USING (household_key, campaign)""",
    "weighted": "SELECT *, 1 / (CASE WHEN treatment = 1 THEN propensity ELSE 1 - propensity END) AS ipw_weight, propensity BETWEEN 0.05 AND 0.95 AS in_overlap FROM scored",
}
