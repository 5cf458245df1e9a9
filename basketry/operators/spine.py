"""The household x campaign grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Tables


def campaign_dim(tables: Tables) -> DataFrame:
    """Campaigns with their rank in time, length in days, how many others overlap them, and whether the data end before they do."""
    c = tables.campaigns
    o = c.select(F.col("campaign").alias("other"), F.col("start_day").alias("other_start"), F.col("end_day").alias("other_end"))
    # a campaign table has one row a campaign; the join is between those rows only
    overlaps = c.join(F.broadcast(o), (F.col("other") != F.col("campaign")) & (F.col("other_start") <= F.col("end_day")) & (F.col("other_end") >= F.col("start_day")), "left")
    counted = overlaps.groupBy("campaign", "campaign_type", "start_day", "end_day").agg(F.count("other").alias("n_overlapping_campaigns"))
    last = tables.transactions.agg(F.max("day").alias("last_day"))
    return counted.crossJoin(F.broadcast(last)).select(
        "campaign", "campaign_type", "start_day", "end_day",
        F.row_number().over(Window.orderBy("start_day", "end_day", "campaign")).cast("long").alias("chrono_rank"),
        (F.col("end_day") - F.col("start_day") + 1).alias("duration_days"), "n_overlapping_campaigns",
        (F.col("end_day") > F.col("last_day")).cast("long").alias("window_truncated_flag"),
    )


def grid(tables: Tables) -> DataFrame:
    """Every household with a purchase, with every campaign."""
    return tables.transactions.select("household_key").distinct().crossJoin(F.broadcast(campaign_dim(tables)))


def mailed(tables: Tables) -> DataFrame:
    flag = tables.mailings.select("household_key", "campaign", F.lit(1).cast("long").alias("mailed_flag")).distinct()
    return grid(tables).join(flag, ["household_key", "campaign"], "left").fillna(0, ["mailed_flag"])


def redeemed(tables: Tables) -> DataFrame:
    """mailed() with redemptions at all and within the campaign's window."""
    r = tables.redemptions.join(F.broadcast(tables.campaigns.select("campaign", "start_day", "end_day")), "campaign")
    inside = F.col("day").between(F.col("start_day"), F.col("end_day"))
    counts = r.groupBy("household_key", "campaign").agg(F.count(F.lit(1)).alias("n_redemptions"), F.count_if(inside).alias("n_redemptions_in_window"))
    out = mailed(tables).join(counts, ["household_key", "campaign"], "left").fillna(0, ["n_redemptions", "n_redemptions_in_window"])
    return out.withColumn("redeemed_flag", (F.col("n_redemptions") > 0).cast("long"))


def spine(tables: Tables) -> DataFrame:
    """redeemed() with each household's first day, its days of history before the campaign, and whether its demographics are known."""
    first = tables.transactions.groupBy("household_key").agg(F.min("day").alias("first_txn_day"))
    known = tables.demographics.select("household_key", F.lit(1).cast("long").alias("has_demographics")).distinct()
    out = redeemed(tables).join(first, "household_key", "left").join(known, "household_key", "left").fillna(0, ["has_demographics"])
    return out.withColumn("history_days_before_start", F.col("start_day") - F.col("first_txn_day"))


def checks(tables: Tables) -> DataFrame:
    """(name, actual, expected) of the grid's invariants, from one aggregate of it."""
    s = spine(tables)
    row = s.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("household_key", "campaign").alias("keys"), F.sum("mailed_flag").alias("mailed"), F.sum("redeemed_flag").alias("redeemed"),
        F.count_if((F.col("redeemed_flag") == 1) & (F.col("mailed_flag") == 0)).alias("redeemed_not_mailed"), F.count_if(F.col("first_txn_day").isNull()).alias("no_first_day"),
        F.count_if(F.col("duration_days") <= 0).alias("bad_duration"), F.count_if(F.col("n_redemptions_in_window") > F.col("n_redemptions")).alias("more_in_window"),
    )
    n = tables.transactions.select("household_key").distinct().count() * tables.campaigns.count()
    households = tables.transactions.select("household_key").distinct()
    n_mailed = tables.mailings.select("household_key", "campaign").distinct().join(households, "household_key", "left_semi").count()
    n_redeemed = tables.redemptions.select("household_key", "campaign").distinct().count()
    pairs = [("rows", n), ("keys", n), ("mailed", n_mailed), ("redeemed", n_redeemed), ("redeemed_not_mailed", 0), ("no_first_day", 0), ("bad_duration", 0), ("more_in_window", 0)]
    stacked = ", ".join(f"'{name}', {name}, {expected}L" for name, expected in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {stacked}) AS (name, actual, expected)")


def rates(tables: Tables) -> DataFrame:
    """Redemption rate of mailed households by campaign type and overall."""
    m = redeemed(tables).where("mailed_flag = 1")
    out = m.rollup("campaign_type").agg(F.count(F.lit(1)).alias("mailed"), F.sum("redeemed_flag").alias("redeemed"))
    return out.select(F.coalesce("campaign_type", F.lit("all")).alias("campaign_type"), "mailed", "redeemed", (F.col("redeemed") / F.col("mailed")).alias("rate"))


def redemption_rate(t: Tables) -> DataFrame:
    """One row for each campaign type, and for all: distinct mailings, those with a redemption, their share, and redeemed pairs that were not mailed."""
    pair = ["household_key", "campaign"]
    mailed = t.mailings.select(*pair).distinct().withColumn("sent", F.lit(True))
    redeemed = t.redemptions.select(*pair).distinct().withColumn("hit", F.lit(True))
    both = mailed.join(redeemed, pair, "full").join(F.broadcast(t.campaigns.select("campaign", "campaign_type")), "campaign", "left")
    sent, hit = F.col("sent").isNotNull(), F.col("hit").isNotNull()
    g = both.withColumn("group", F.explode(F.array(F.lit("all"), "campaign_type"))).groupBy("group").agg(F.count_if(sent).alias("mailings"), F.count_if(sent & hit).alias("redeemed"), F.count_if(~sent).alias("not_mailed"))
    return g.select("group", "mailings", "redeemed", (F.col("redeemed") / F.col("mailings")).alias("rate"), "not_mailed")
