"""What households bought in a campaign's window, promoted purchases set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Tables, week_of
from .spine import spine

PAIR = ["household_key", "campaign"]


def promoted(tables: Tables, only_bc: bool = True) -> DataFrame:
    """One row a (product, store, week): was it on display, was it in a flyer, by any of its rows. only_bc: products of campaigns other than type A."""
    causal = tables.causal
    if only_bc:
        open_ = tables.campaigns.where("campaign_type <> 'A'").select("campaign")
        causal = causal.join(tables.campaign_products().join(F.broadcast(open_), "campaign", "left_semi").select("product_id").distinct(), "product_id", "left_semi")
    return causal.groupBy("product_id", "store_id", "week_no").agg(F.max((F.col("display") != "0").cast("long")).alias("on_display"), F.max((F.col("mailer") != "0").cast("long")).alias("in_flyer"))


def promoted_for(tables: Tables, lines: DataFrame) -> DataFrame:
    """promoted() for the products, stores and weeks that lines hold.

    Promotions far outnumber lines, so they are reduced by the product first, against a list of its stores and
    weeks; the hint keeps that a join of hash tables by partition, whatever size is guessed for either side.
    """
    wanted = lines.select("product_id", "store_id", "week_no").distinct().groupBy("product_id").agg(F.collect_list(F.struct("store_id", "week_no")).alias("_wanted"))
    met = tables.causal.join(wanted.hint("shuffle_hash"), "product_id").where(F.array_contains("_wanted", F.struct("store_id", "week_no"))).drop("_wanted")
    return promoted(tables.with_(causal=met), only_bc=False)


def with_promotions(tables: Tables, lines: DataFrame) -> DataFrame:
    """lines with on_display and in_flyer, null without a promotion."""
    # merge: no side of this join is sent to the driver on the strength of a guess
    return lines.join(promoted_for(tables, lines).hint("merge"), ["product_id", "store_id", "week_no"], "left")


def calendar(tables: Tables) -> DataFrame:
    """One row for each day on which a campaign runs."""
    return tables.campaigns.select("campaign", "campaign_type", F.explode(F.sequence("start_day", "end_day")).alias("day"))


def offered_buys(tables: Tables) -> DataFrame:
    """Lines that fall on a day of a campaign and hold one of its products, with that product's coupons in the campaign.

    The day comes first: few campaigns run on one day, while a product may belong to many.
    """
    lines = tables.transactions.select("household_key", "product_id", "store_id", "day", "week_no", F.col("sales_cents").alias("cents"))
    offers = tables.coupons.groupBy("campaign", "product_id").agg(F.collect_set("coupon_upc").alias("coupons"))
    return lines.join(calendar(tables), "day").join(offers.hint("merge"), ["campaign", "product_id"]).select(*PAIR, "campaign_type", "product_id", "store_id", "week_no", "cents", "coupons")


def buys(tables: Tables) -> DataFrame:
    """offered_buys() without the coupons."""
    return offered_buys(tables).drop("coupons")


def with_redeemed(tables: Tables, lines: DataFrame) -> DataFrame:
    """lines of offered_buys() with redeemed: did the household redeem one of the product's coupons in the campaign?

    A coupon may belong to any number of products, so redemptions are not multiplied by them; each line looks for its own coupons.
    """
    used = tables.redemptions.groupBy(*PAIR).agg(F.collect_set("coupon_upc").alias("_used"))
    return lines.join(used.hint("merge"), PAIR, "left").withColumn("redeemed", F.coalesce(F.arrays_overlap("coupons", "_used"), F.lit(False))).drop("coupons", "_used")


def window_sums(tables: Tables) -> DataFrame:
    """One row for each household with lines in a campaign's window: cents, cents of products it redeemed (null without any), and 0/1 for lines of three kinds.

    plain: neither displayed nor in a flyer that week in that store; unshown: not displayed; plain_redeemed: a plain line of a redeemed product.
    """
    lines = with_redeemed(tables, with_promotions(tables, offered_buys(tables)))
    unshown = F.coalesce("on_display", F.lit(0)) == 0
    plain = unshown & (F.coalesce("in_flyer", F.lit(0)) == 0)
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("long"))
    return lines.groupBy(*PAIR, "campaign_type").agg(
        F.sum("cents").alias("cents"), F.sum(F.when(F.col("redeemed"), F.col("cents"))).alias("redeemed_cents"),
        any_(plain).alias("plain"), any_(unshown).alias("unshown"), any_(plain & F.col("redeemed")).alias("plain_redeemed"),
    )


def spend(tables: Tables) -> DataFrame:
    return buys(tables).groupBy(*PAIR).agg((F.sum("cents") / 100).alias("campaign_product_spend_during"))


def redeemed_spend(tables: Tables) -> DataFrame:
    return with_redeemed(tables, offered_buys(tables)).where("redeemed").groupBy(*PAIR).agg((F.sum("cents") / 100).alias("redeemed_coupon_product_spend_during"))


def _bought(sums: DataFrame) -> DataFrame:
    # one redeemed item clears the last flag even if others were bought
    return sums.withColumns({"bought_excl_display_flyer": F.col("plain"), "bought_excl_display": F.col("unshown"), "bought_without_redemption": F.col("plain") - F.col("plain_redeemed")})


def bought(tables: Tables) -> DataFrame:
    """0/1 for households of type B and C campaigns: bought an item that was neither displayed nor in a flyer, not displayed, and such an item without a redemption."""
    return _bought(window_sums(tables).where("campaign_type <> 'A'")).select(*PAIR, "bought_excl_display_flyer", "bought_excl_display", "bought_without_redemption")


def overlap(tables: Tables) -> DataFrame:
    """Grid rows whose household was mailed another campaign with an overlapping window."""
    households = tables.transactions.select("household_key").distinct()
    c = tables.campaigns.select("campaign", "start_day", "end_day")
    o = c.selectExpr("campaign AS other", "start_day AS other_start", "end_day AS other_end")
    meet = c.join(F.broadcast(o), (F.col("campaign") != F.col("other")) & (F.col("other_start") <= F.col("end_day")) & (F.col("other_end") >= F.col("start_day"))).select("campaign", "other")
    sent = tables.mailings.select("household_key", F.col("campaign").alias("other")).distinct().join(households, "household_key", "left_semi")
    return sent.join(F.broadcast(meet), "other").select(*PAIR).distinct()


def usual_store(tables: Tables) -> DataFrame:
    """The store with most lines before the campaign starts; the smaller number wins ties.

    Lines are counted by the first start day after them, so a household's history
    meets the campaigns as at most one row for each of its stores and start days.
    """
    starts = tables.campaigns.select(F.sort_array(F.collect_set("start_day")).alias("starts"))  # one row, of as many numbers as the checked campaign table has
    first_after = F.try_element_at(F.filter("starts", lambda s: s > F.col("day")), F.lit(1))
    counted = tables.transactions.crossJoin(F.broadcast(starts)).select("household_key", "store_id", first_after.alias("next_start"))
    # dealt by household once, which serves all groupings that follow
    spans = counted.where("next_start is not null").repartition("household_key").groupBy("household_key", "store_id", "next_start").agg(F.count(F.lit(1)).alias("n"))
    counts = spans.join(F.broadcast(tables.campaigns.select("campaign", "start_day")), F.col("next_start") <= F.col("start_day")).groupBy(*PAIR, "store_id").agg(F.sum("n").alias("n"))
    return counts.groupBy(*PAIR).agg(F.min(F.struct((-F.col("n")).alias("n"), "store_id"))["store_id"].alias("store_id"))


def promo_share(tables: Tables) -> DataFrame:
    """Share of a campaign's weeks in which one of its products was promoted at the household's usual store."""
    weeks = tables.campaigns.where("campaign_type <> 'A'").select("campaign", week_of(F.col("start_day")).alias("first_week"), week_of(F.col("end_day")).alias("last_week"))
    offered = tables.campaign_products().join(F.broadcast(weeks), "campaign").select("campaign", "product_id", "first_week", "last_week")
    shown = tables.causal.where("display <> '0' or mailer <> '0'").join(offered.hint("shuffle_hash"), "product_id").where("week_no between first_week and last_week")
    # by store, not by household: each store's number of promoted weeks is counted once
    by_store = shown.groupBy("campaign", "store_id").agg(F.count_distinct("week_no").alias("n_promo_weeks"))
    out = usual_store(tables).join(F.broadcast(weeks), "campaign").join(by_store, ["campaign", "store_id"], "left")
    share = F.coalesce("n_promo_weeks", F.lit(0)).cast("double") / (F.col("last_week") - F.col("first_week") + 1)
    return out.select(*PAIR, share.alias("campaign_promo_share"))


def plain_bought(tables: Tables) -> DataFrame:
    """bought_excl_display_flyer of bought() alone, for which no redemption is looked up."""
    lines = with_promotions(tables, buys(tables).where("campaign_type <> 'A'"))
    plain = (F.coalesce("on_display", F.lit(0)) == 0) & (F.coalesce("in_flyer", F.lit(0)) == 0)
    return lines.groupBy(*PAIR).agg(F.max(plain.cast("long")).alias("bought_excl_display_flyer"))


def with_overlap(tables: Tables, rows: DataFrame) -> DataFrame:
    flag = overlap(tables).withColumn("mailed_overlapping_campaign", F.lit(1).cast("long"))
    return rows.join(flag, PAIR, "left").fillna(0, ["mailed_overlapping_campaign"])


def outcome(tables: Tables, rows: DataFrame, name: str) -> DataFrame:
    """rows with one column of outcome_table(), from no more than it needs; a column that rows have already stays."""
    if name in rows.columns:
        return rows
    if name == "campaign_product_spend_during":
        return rows.join(spend(tables), PAIR, "left").fillna(0.0, [name])
    if name == "bought_excl_display_flyer":
        found = rows.join(plain_bought(tables), PAIR, "left")
        return found.withColumn(name, F.when(F.col("campaign_type") != "A", F.coalesce(name, F.lit(0)).cast("double")))
    return rows.join(outcome_table(tables, rows).select(*PAIR, name), PAIR, "left")


def outcome_table(tables: Tables, rows: DataFrame | None = None) -> DataFrame:
    """One row for each grid row with all outcomes; null where an outcome has no meaning."""
    rows = (spine(tables) if rows is None else rows).select(*PAIR, "campaign_type", "redeemed_flag")
    flag = overlap(tables).withColumn("mailed_overlapping_campaign", F.lit(1).cast("long"))
    out = rows.join(_bought(window_sums(tables)).drop("campaign_type"), PAIR, "left").join(flag, PAIR, "left").join(promo_share(tables), PAIR, "left")
    open_ = F.col("campaign_type") != "A"
    return out.select(
        *PAIR, (F.coalesce("cents", F.lit(0)) / 100).alias("campaign_product_spend_during"),
        F.when(F.col("redeemed_flag") == 1, F.coalesce("redeemed_cents", F.lit(0)) / 100).alias("redeemed_coupon_product_spend_during"),
        *[F.when(open_, F.coalesce(c, F.lit(0)).cast("double")).alias(c) for c in ("bought_excl_display_flyer", "bought_excl_display", "bought_without_redemption")],
        F.coalesce("mailed_overlapping_campaign", F.lit(0)).alias("mailed_overlapping_campaign"), "campaign_promo_share",
    )
