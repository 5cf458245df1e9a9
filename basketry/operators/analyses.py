"""Questions about uplift, products and changes in the data."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Tables
from . import metrics, outcomes

PAIR = ["household_key", "campaign"]


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; absolute error below 7.5e-8."""
    # The published coefficients.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    k = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * sum((F.lit(c) * F.pow(k, i + 1) for i, c in enumerate(b)), F.lit(0.0))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def ate_test(df: DataFrame, label: str, treatment: str) -> DataFrame:
    """Two-proportion z-test of treated against control rows."""
    t, y = F.col(treatment) == 1, F.col(label)
    g = df.agg(F.count_if(t).alias("nt"), F.count_if(~t).alias("nc"), F.sum(F.when(t, y)).alias("yt"), F.sum(F.when(~t, y)).alias("yc"))
    pt, pc, p = F.col("yt") / F.col("nt"), F.col("yc") / F.col("nc"), (F.col("yt") + F.col("yc")) / (F.col("nt") + F.col("nc"))
    z = (pt - pc) / F.sqrt(p * (1 - p) * (1 / F.col("nt") + 1 / F.col("nc")))
    return g.select(pt.alias("treated_rate"), pc.alias("control_rate"), (pt - pc).alias("uplift"), z.alias("z"), (2 * (1 - normal_cdf(F.abs(z)))).alias("p_value"))


def spend_tiers(df: DataFrame, spend: str, label: str, treatment: str) -> DataFrame:
    """Uplift by thirds of spend, cut where the treated rows' thirds are."""
    cut = df.where(F.col(treatment) == 1).agg(F.percentile(spend, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cut"))
    tier = F.when(F.col(spend) <= F.col("cut")[0], "low").when(F.col(spend) <= F.col("cut")[1], "medium").otherwise("high")
    return metrics.uplift_in(df.crossJoin(F.broadcast(cut)).withColumn("tier", tier), ["tier"], label, treatment)


def demographic_uplift(df: DataFrame, demographics: DataFrame, column: str, label: str, treatment: str, least: int = 20) -> DataFrame:
    joined = df.join(demographics.select("household_key", column), "household_key")
    return metrics.uplift_in(joined, [column], label, treatment).where(F.col("n_treated") >= least)


def redemption_split(df: DataFrame, least: int = 0) -> DataFrame:
    """Treated buyers with and without a redemption, for each campaign with enough of them."""
    buyers = df.where("treatment = 1 and label = 1")
    g = buyers.groupBy("campaign").agg(F.count(F.lit(1)).alias("n_buyers"), F.count_if(F.col("redeemed") == 0).alias("n_without"))
    return g.where(F.col("n_buyers") >= least).withColumn("share_without", F.col("n_without") / F.col("n_buyers"))


def selection_bias(df: DataFrame, columns: list[str], treatment: str) -> DataFrame:
    """(column, treated, control, ratio) of means."""
    stacked = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    x = df.selectExpr(f"{treatment} AS t", f"stack({len(columns)}, {stacked}) AS (`column`, x)")
    g = x.groupBy("column").agg(F.avg(F.when(F.col("t") == 1, F.col("x"))).alias("treated"), F.avg(F.when(F.col("t") != 1, F.col("x"))).alias("control"))
    return g.withColumn("ratio", F.col("treated") / F.col("control"))


def common_support(df: DataFrame, column: str, treatment: str) -> DataFrame:
    """Rows where both arms' 5 to 95 per cent bands of a column meet."""
    ends = lambda t: df.where(F.col(treatment) == t).agg(F.percentile(column, F.array(F.lit(0.05), F.lit(0.95))).alias(f"e{t}"))
    both = df.crossJoin(F.broadcast(ends(0))).crossJoin(F.broadcast(ends(1)))
    low, high = F.greatest(F.col("e0")[0], F.col("e1")[0]), F.least(F.col("e0")[1], F.col("e1")[1])
    return both.where(F.col(column).between(low, high)).drop("e0", "e1")


def clean_control(t: Tables) -> DataFrame:
    """Households and campaigns without a mailing, then or at an overlapping time."""
    grid = t.transactions.select("household_key").distinct().crossJoin(F.broadcast(t.campaigns.select("campaign")))
    return grid.join(t.mailings.select(*PAIR).distinct(), PAIR, "left_anti").join(outcomes.overlap(t), PAIR, "left_anti")


def product_uplift(t: Tables) -> DataFrame:
    """For each product of each campaign of type B or C: treated and control buyers of unpromoted items, treated ones without a redemption, rates and uplift."""
    plain = outcomes.with_promotions(t, outcomes.offered_buys(t).where("campaign_type <> 'A'"))
    plain = outcomes.with_redeemed(t, plain.where("coalesce(on_display, 0) = 0 and coalesce(in_flyer, 0) = 0").select(*PAIR, "product_id", "coupons")).distinct()
    households = t.transactions.select("household_key").distinct()
    mailed = t.mailings.select(*PAIR).distinct()
    # clean control households are counted as all less those with a mailing, then or at an overlapping time
    taken = mailed.join(households, "household_key", "left_semi").unionByName(outcomes.overlap(t)).distinct()
    marked = plain.join(mailed.withColumn("treated", F.lit(True)).hint("merge"), PAIR, "left").join(taken.withColumn("taken", F.lit(True)).hint("merge"), PAIR, "left")
    # rows are distinct households, so counts are distinct counts
    counts = marked.groupBy("campaign", "product_id").agg(F.count("treated").alias("n_treated_bought"), F.count_if(F.col("taken").isNull()).alias("n_control_bought"), F.count_if(F.col("treated") & ~F.col("redeemed")).alias("n_without_redemption"))
    n_taken = taken.groupBy("campaign").agg(F.count(F.lit(1)).alias("n_taken"))
    n_control = households.agg(F.count(F.lit(1)).alias("_n")).crossJoin(n_taken).select("campaign", F.when(F.col("_n") > F.col("n_taken"), F.col("_n") - F.col("n_taken")).alias("n_control"))
    sizes = mailed.join(households, "household_key", "left_semi").groupBy("campaign").agg(F.count(F.lit(1)).alias("n_mailed")).join(n_control, "campaign", "left")
    offers = t.campaign_products().join(F.broadcast(t.campaigns.where("campaign_type <> 'A'").select("campaign")), "campaign")
    out = offers.join(counts.hint("merge"), ["campaign", "product_id"], "left").join(sizes, "campaign", "left").fillna(0, ["n_treated_bought", "n_control_bought", "n_without_redemption"])
    tr, cr = F.col("n_treated_bought") / F.col("n_mailed"), F.col("n_control_bought") / F.col("n_control")
    return out.select("campaign", "product_id", "n_treated_bought", "n_control_bought", "n_without_redemption", tr.alias("treated_rate"), cr.alias("control_rate"), (tr - cr).alias("uplift"))


def product_summary(t: Tables, least: int = 5) -> DataFrame:
    """product_uplift added over campaigns, for products with enough treated buyers."""
    g = product_uplift(t).groupBy("product_id").agg(F.count(F.lit(1)).alias("n_campaigns"), *[F.sum(c).alias(c) for c in ("n_treated_bought", "n_control_bought", "n_without_redemption")])
    return g.where(F.col("n_treated_bought") >= least).withColumn("share_without_redemption", F.col("n_without_redemption") / F.col("n_treated_bought"))


def pool_sizes(t: Tables) -> DataFrame:
    """Products of each campaign, and their share of the catalogue."""
    n = t.products.agg(F.count_distinct("product_id").alias("n_all"))
    return t.campaign_products().groupBy("campaign").agg(F.count(F.lit(1)).alias("n_products")).crossJoin(F.broadcast(n)).select("campaign", "n_products", (F.col("n_products") / F.col("n_all")).alias("share"))


def campaign_features(t: Tables, weeks: int = 26) -> DataFrame:
    """Products and coupons of each campaign, and all households' spend and buyers of them in the weeks before it."""
    c = t.coupons.groupBy("campaign").agg(F.count_distinct("product_id").alias("n_products"), F.count_distinct("coupon_upc").alias("n_coupons"))
    before = t.transactions.join(t.campaign_products(), "product_id").join(F.broadcast(t.campaigns), "campaign").where((F.col("day") < F.col("start_day")) & (F.col("day") >= F.col("start_day") - 7 * weeks))
    per = before.groupBy("campaign", "household_key").agg(F.sum("sales_cents").alias("c")).groupBy("campaign").agg(F.sum("c").alias("population_cents"), F.count(F.lit(1)).alias("population_buyers"))
    return c.join(per, "campaign", "left").fillna(0, ["population_cents", "population_buyers"])


def never_seen(t: Tables, since: int, upto: int) -> DataFrame:
    """(kind, value, n): departments and campaign types of the days after `since` that no earlier day has."""
    lines = t.transactions.where(F.col("day") <= upto).join(t.products.select("product_id", "department"), "product_id").where("department is not null")
    d = lines.groupBy(F.col("department").alias("value")).agg(F.count_if(F.col("day") <= since).alias("before"), F.count_if(F.col("day") > since).alias("n"))
    c = t.campaigns.where(F.col("start_day") <= upto).groupBy(F.col("campaign_type").alias("value")).agg(F.count_if(F.col("start_day") <= since).alias("before"), F.count_if(F.col("start_day") > since).alias("n"))
    new = lambda df, kind: df.where("before = 0 and n > 0").select(F.lit(kind).alias("kind"), "value", "n")
    return new(d, "department").union(new(c, "campaign_type"))


def unusual_moves(per_campaign: DataFrame, value: str, order: str, sds: float = 3.0, relative: float = 0.1, least: int = 3) -> DataFrame:
    """Campaigns whose value moved by more than so many standard deviations of all earlier moves and more than a share of the value before."""
    w = Window.orderBy(order)
    x = per_campaign.withColumn("before", F.lag(value).over(w)).withColumn("place", F.row_number().over(w) - 1).withColumn("move", F.col(value) - F.col("before"))
    x = x.withColumn("usual", F.stddev_samp("move").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return x.where((F.col("place") >= least + 1) & (F.abs("move") > sds * F.col("usual")) & (F.abs("move") > relative * F.abs("before"))).drop("place")


def unusual_blanks(per_campaign: DataFrame, share: str, order: str, sds: float = 3.0, least_move: float = 0.1, least: int = 3) -> DataFrame:
    """Campaigns whose share of blanks rose by more than so many standard deviations of all earlier moves and by more than least_move; fewer blanks are no problem."""
    w = Window.orderBy(order)  # one row a campaign
    x = per_campaign.withColumn("before", F.lag(share).over(w)).withColumn("place", F.row_number().over(w) - 1).withColumn("move", F.col(share) - F.col("before"))
    x = x.withColumn("usual", F.stddev_samp("move").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return x.where((F.col("place") >= least + 1) & (F.col("move") > sds * F.col("usual")) & (F.col("move") > least_move)).drop("place")


def same_habit_auc(df: DataFrame, score: str, label: str, habit: str) -> DataFrame:
    """AUC inside campaign and fifth of a habit, averaged by positives."""
    # a campaign's rows are ranked by habit, ties by household
    place = F.row_number().over(Window.partitionBy("campaign").orderBy(habit, "household_key"))
    n = F.count(F.lit(1)).over(Window.partitionBy("campaign"))
    fifth = F.floor((place - 1) * 5 / n).cast("long")
    x = df.withColumn("fifth", fifth)
    varied = x.groupBy("campaign", "fifth").agg((F.min(score) < F.max(score)).alias("varied"))  # cells with one score tell nothing
    a = metrics.auc(x, score, label, ["campaign", "fifth"]).join(varied, ["campaign", "fifth"]).where("auc is not null and varied")
    return a.agg((F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")).alias("auc"))


def signal_screen(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(column, auc) of each column alone, folded to 0.5 and above; null with one class. All columns are ranked at once, each by ranges of its values."""
    stacked = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
    x = df.select(F.col(label).cast("long").alias("y"), F.expr(f"stack({len(columns)}, {stacked}) AS (column, s)")).where("s is not null")
    g = metrics.ranked_by_ranges(x.groupBy("column", "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")), ["column"])
    parts = metrics._auc_parts(g, ["column"])
    pairs = 2 * F.col("pos") * (F.col("n") - F.col("pos"))
    auc = F.when(pairs > 0, F.col("wins2") / pairs)
    return parts.select("column", F.greatest(auc, 1 - auc).alias("auc"))


def depth_table(df: DataFrame, scores: list[str], label: str, shares=(0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """(ranking, campaign_type, share, capture) of several scores."""
    stacked = ", ".join(f"'{c}', {c}" for c in scores)
    x = df.selectExpr("campaign", "campaign_type", f"{label} AS y", f"stack({len(scores)}, {stacked}) AS (ranking, s0)")
    g = metrics._groups(x, "s0", "y", ["ranking", "campaign_type", "campaign"]).withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return g.groupBy("ranking", "campaign_type", "share").agg((F.sum(metrics._caught(metrics._depth(F.col("n_all"), F.col("share")))) / F.sum("pos")).alias("capture"))
