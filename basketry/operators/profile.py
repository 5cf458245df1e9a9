"""Point-in-time features of a household: nothing on or after the cutoff day counts.

The windows of 8 and 26 weeks come from one join of the cutoff rows to the
household's lines, and one grouping with conditional aggregates. What looks at all history (first day, last day, all coupon lines) comes
from running sums over a household's days, among which its cutoffs are sorted, so
no line is repeated for it. Lines look for their product once they have met their cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import LABELS, Tables

KEY = ["household_key", "campaign", "cutoff_day"]


def cutoffs(spine: DataFrame, gap: int = 0) -> DataFrame:
    return spine.select("household_key", "campaign", (F.col("start_day") - gap).alias("cutoff_day"))


def _alone(df: DataFrame) -> list[str]:
    """The column cutoff_day, if df has it: then all of a household's cutoff rows are of that day, and lines of other days need not be dealt to know that."""
    return ["cutoff_day"] if "cutoff_day" in df.columns else []


def _window(weeks: int) -> Column:
    return F.col("day") >= F.col("cutoff_day") - 7 * weeks


HALF_YEAR = 7 * 26


def _lines(t: Tables, rows: DataFrame, of_products: bool = True) -> DataFrame:
    """Cutoff rows with their lines of the 26 weeks before: whether a line is of the last 8 weeks, and whether its product (or, on coupon lines, its commodity) is the campaign's. commodity is null on lines without a coupon.

    Lines meet cutoffs first, so only those inside a window look for their product, and the campaigns that offer it
    are not carried along: a line takes two flags of them. Without of_products lines do not meet products, and what
    those know is null.
    """
    coupon = F.col("coupon_disc_cents") < 0
    lines = t.transactions.select(
        "household_key", *_alone(t.transactions), "day", "basket_id", "product_id", F.col("sales_cents").alias("cents"),
        F.when(F.col("retail_disc_cents") < 0, F.col("sales_cents")).otherwise(0).alias("discount_cents"), coupon.cast("long").alias("coupon_lines"),
    )
    # merge: neither side is sent to the driver on the strength of a guess
    both = rows.select(*KEY).join(lines.hint("merge"), ["household_key", *_alone(lines)]).where((F.col("day") < F.col("cutoff_day")) & _window(26))
    both = both.select(*KEY, "basket_id", "product_id", "cents", "discount_cents", "coupon_lines", _window(8).alias("recent"))
    if not of_products:
        none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
        return both.drop("product_id").select("*", *none("string", "department", "commodity"), *none("boolean", "own_product", "own_kind"))
    offers = t.campaign_products()
    own = offers.groupBy("product_id").agg(F.collect_set("campaign").alias("own"))
    kinds = offers.join(t.products, "product_id").select("campaign", "commodity").where("commodity is not null").groupBy("commodity").agg(F.collect_set("campaign").alias("kinds"))
    known = t.products.select("product_id", "department", "commodity").join(kinds, "commodity", "left")
    with_coupon = F.col("coupon_lines") > 0
    has = lambda c: F.coalesce(F.array_contains(c, F.col("campaign")), F.lit(False))
    both = both.join(known.hint("merge"), "product_id", "left").join(own.hint("merge"), "product_id", "left")
    return both.select(
        *KEY, "basket_id", "cents", "discount_cents", "coupon_lines", "recent", "department", F.when(with_coupon, F.col("commodity")).alias("commodity"),
        has("own").alias("own_product"), (with_coupon & has("kinds")).alias("own_kind"),
    )


def _history(t: Tables, rows: DataFrame) -> DataFrame:
    """first_day, last_day and coupons_all of the days before each cutoff; rows without such a day are left out."""
    none = F.lit(None).cast("long")
    # days between which no cutoff lies may stand for one: those before the household's only cutoff day, and those from it on
    at = F.when(F.col("day") < F.col("cutoff_day"), F.col("cutoff_day") - 1).otherwise(F.col("cutoff_day")) if _alone(t.transactions) else F.col("day")
    days = t.transactions.groupBy("household_key", at.alias("at")).agg(F.min("day").alias("day"), F.max("day").alias("to_day"), F.count_if(F.col("coupon_disc_cents") < 0).alias("coupons"))
    days = days.select("household_key", "at", F.lit(1).alias("later"), "day", "to_day", "coupons", none.alias("campaign"))
    asked = rows.select("household_key", F.col("cutoff_day").alias("at"), F.lit(0).alias("later"), none.alias("day"), none.alias("to_day"), F.lit(0).cast("long").alias("coupons"), "campaign")
    so_far = Window.partitionBy("household_key").orderBy("at", "later").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = days.unionByName(asked).withColumns({"first_day": F.min("day").over(so_far), "last_day": F.max("to_day").over(so_far), "coupons_all": F.sum("coupons").over(so_far)})
    return known.where("later = 0 and first_day is not null").select("household_key", "campaign", F.col("at").alias("cutoff_day"), "first_day", "last_day", "coupons_all")


def _habits(t: Tables, rows: DataFrame, of_products: bool = True) -> DataFrame:
    x = _lines(t, rows, of_products)
    if of_products:  # lines are dealt by household once more, which serves both groupings and the joins with what else is dealt so
        x = x.repartition("household_key")
    total = lambda c, *where: F.sum(F.when(_all(where), F.col(c)).otherwise(0))
    recent = F.col("recent")
    # distinct counts in two steps: one row a basket first, then one a cutoff row
    baskets = x.groupBy(*KEY, "basket_id").agg(
        F.max(recent).alias("in_8"), F.max(F.col("coupon_lines") > 0).alias("with_coupon"), total("cents", recent).alias("cents_8"), F.sum("cents").alias("cents_26"), F.sum("discount_cents").alias("discount_26"),
        total("coupon_lines", recent).alias("coupons_8"), F.sum("coupon_lines").alias("coupons_26"), total("cents", F.col("own_product")).alias("own_cents"),
        total("coupon_lines", F.col("own_product")).alias("own_coupons"), total("coupon_lines", F.col("own_kind")).alias("kind_coupons"),
        F.collect_set("department").alias("departments"), F.collect_set(F.when(F.col("coupon_lines") > 0, F.col("commodity"))).alias("commodities"),
    )
    sums = [F.sum(c).alias(c) for c in ("cents_8", "cents_26", "discount_26", "coupons_8", "coupons_26", "own_cents", "own_coupons", "kind_coupons")]
    kinds = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long")
    habits = baskets.groupBy(*KEY).agg(
        *sums, kinds("departments").alias("departments"), kinds("commodities").alias("coupon_commodities"),
        F.count_if("in_8").alias("trips_8"), F.count(F.lit(1)).alias("trips_26"), F.count_if("with_coupon").alias("coupon_trips_26"),
    )
    return _history(t, rows).join(habits, KEY, "left")


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _past_campaigns(t: Tables, rows: DataFrame) -> DataFrame:
    """Redemptions before the cutoff, and campaigns that ended before it, with the newest ones' result.

    A campaign counts as redeemed from its first redemption on, so redemptions meet mailings before either meets the
    cutoffs, and the pairs of a cutoff with its past campaigns are summed where the join makes them.
    """
    r = rows.select(*KEY).join(t.redemptions.select("household_key", F.col("day").alias("on")), "household_key").where("`on` < cutoff_day")
    redeemed = r.groupBy(*KEY).agg(F.count(F.lit(1)).alias("past_redemptions"))
    first = t.redemptions.groupBy("household_key", "campaign").agg(F.min("day").alias("first_on"))
    dates = t.campaigns.select("campaign", F.col("end_day").alias("past_end"))
    sent = t.mailings.select("household_key", "campaign", *_alone(t.mailings)).join(F.broadcast(dates), "campaign").join(first.hint("merge"), ["household_key", "campaign"], "left").drop("campaign")
    ended = rows.select(*KEY).join(sent.hint("merge"), ["household_key", *_alone(sent)]).where("past_end < cutoff_day").withColumn("hit", F.coalesce(F.col("first_on") < F.col("cutoff_day"), F.lit(False)).cast("long"))
    newest = F.max(F.struct("past_end", "hit"))["hit"]
    got = ended.groupBy(*KEY).agg(F.count(F.lit(1)).alias("past_campaigns_received"), F.sum("hit").alias("past_campaigns_redeemed"), newest.alias("redeemed_last_campaign"))
    return rows.select(*KEY).join(redeemed, KEY, "left").join(got, KEY, "left").fillna(0, ["past_redemptions", "past_campaigns_received", "past_campaigns_redeemed"])


def _kind_redemptions(t: Tables, rows: DataFrame) -> DataFrame:
    """Distinct coupons redeemed before the cutoff whose commodities meet the campaign's. Coupons are matched by their code alone."""
    kinds_of = t.coupons.select("coupon_upc", "product_id").distinct().join(t.products, "product_id").where("commodity is not null").select("coupon_upc", "commodity").distinct()
    kinds = t.campaign_products().join(t.products, "product_id").where("commodity is not null").select("campaign", "commodity").distinct()
    meets = kinds_of.join(kinds, "commodity").select("campaign", "coupon_upc").distinct()
    r = rows.select(*KEY).join(t.redemptions.select("household_key", "coupon_upc", F.col("day").alias("on")), "household_key").where("`on` < cutoff_day")
    return r.join(meets, ["campaign", "coupon_upc"], "left_semi").groupBy(*KEY).agg(F.count_distinct("coupon_upc").alias("past_redemptions_in_campaign_commodities"))


def _live(t: Tables, rows: DataFrame) -> DataFrame:
    sent = t.mailings.join(F.broadcast(t.campaigns), "campaign").selectExpr("household_key", *_alone(t.mailings), "campaign AS other", "start_day AS other_start", "end_day AS other_end")
    live = rows.select(*KEY).join(sent, ["household_key", *_alone(sent)]).where("other <> campaign and other_start < cutoff_day and other_end >= cutoff_day")
    return live.groupBy(*KEY).agg(F.count(F.lit(1)).alias("other_campaigns_live_at_cutoff"))


def profiles(t: Tables, rows: DataFrame) -> DataFrame:
    """Features of each row of rows (household_key, campaign, cutoff_day). Households without lines count as zero where a count or sum has a meaning, else as null."""
    out = _of_lines(t, rows).join(_past(t, rows), KEY).join(_kind_redemptions(t, rows), KEY, "left").join(_live(t, rows), KEY, "left").fillna(0, [*OF_KINDS, *OF_LIVE])
    return out.join(_demographics(t, rows), KEY)


#: What is made of more than a household's lines: of their products, of past campaigns, of redeemed coupons' commodities, of running campaigns, and of demographics.
OF_PRODUCTS = ("n_departments_26w", "coupon_commodities_26w", "campaign_product_spend_per_week_26w", "campaign_product_share_26w", "campaign_product_coupon_lines_per_week_26w", "campaign_commodity_coupon_lines_per_week_26w")
OF_PAST = ("past_redemptions", "past_campaigns_received", "past_campaigns_redeemed", "redeemed_last_campaign", "past_redemption_rate")
OF_KINDS, OF_LIVE, OF_DEMOGRAPHICS = ("past_redemptions_in_campaign_commodities",), ("other_campaigns_live_at_cutoff",), (*LABELS, *[f"{c}_code" for c in LABELS])


def profiles_of(t: Tables, rows: DataFrame, columns: list[str]) -> DataFrame:
    """profiles() with some of its columns; what only the others need is not made."""
    asked = lambda names: not set(names).isdisjoint(columns)
    if all(map(asked, (OF_PRODUCTS, OF_PAST, OF_KINDS, OF_LIVE, OF_DEMOGRAPHICS))):
        return profiles(t, rows).select(*KEY, *columns)
    out = _of_lines(t, rows, asked(OF_PRODUCTS))
    if asked(OF_PAST):
        out = out.join(_past(t, rows), KEY)
    for names, make in ((OF_KINDS, _kind_redemptions), (OF_LIVE, _live)):
        if asked(names):
            out = out.join(make(t, rows), KEY, "left").fillna(0, list(names))
    return (out.join(_demographics(t, rows), KEY) if asked(OF_DEMOGRAPHICS) else out).select(*KEY, *columns)


def _of_lines(t: Tables, rows: DataFrame, of_products: bool = True) -> DataFrame:
    h = rows.select(*KEY).join(_habits(t, rows, of_products), KEY, "left")
    numbers = [c for c in h.columns if c not in (*KEY, "first_day", "last_day")]
    h = h.fillna(0, numbers)
    days = F.col("cutoff_day") - F.col("first_day")
    known = F.col("first_day").isNotNull()
    weeks = lambda w: F.when(known, F.least(F.lit(7 * w), days) / 7)
    money = lambda c: F.col(c) / 100
    spent = F.col("cents_26") > 0
    return h.select(
        *KEY, (F.coalesce(days, F.lit(0)) / 7).alias("history_weeks_before_cutoff"), (F.coalesce(days, F.lit(0)) < 182).cast("long").alias("short_history_flag"), (~known).cast("long").alias("no_history_flag"),
        *[(money(f"cents_{w}") / weeks(w)).alias(f"spend_per_week_{w}w") for w in (8, 26)], *[(F.col(f"trips_{w}") / weeks(w)).alias(f"trips_per_week_{w}w") for w in (8, 26)],
        F.when(spent, money("cents_26") / F.col("trips_26")).alias("avg_basket_value_26w"), (F.col("cutoff_day") - F.col("last_day")).alias("days_since_last_trip"), F.when(known, F.col("departments")).alias("n_departments_26w"),
        F.when(spent, F.col("discount_26") / F.col("cents_26")).alias("share_spend_on_discount_26w"), *[(F.col(f"coupons_{w}") / weeks(w)).alias(f"coupon_lines_per_week_{w}w") for w in (8, 26)],
        F.when(known, F.col("coupons_all") / (days / 7)).alias("coupon_lines_per_week_all"), F.when(F.col("trips_26") > 0, F.col("coupon_trips_26") / F.col("trips_26")).alias("coupon_trip_share_26w"),
        F.when(known, F.col("coupon_commodities")).alias("coupon_commodities_26w"), (money("own_cents") / weeks(26)).alias("campaign_product_spend_per_week_26w"), F.when(spent, F.col("own_cents") / F.col("cents_26")).alias("campaign_product_share_26w"),
        (F.col("own_coupons") / weeks(26)).alias("campaign_product_coupon_lines_per_week_26w"), (F.col("kind_coupons") / weeks(26)).alias("campaign_commodity_coupon_lines_per_week_26w"),
    )


def _past(t: Tables, rows: DataFrame) -> DataFrame:
    return _past_campaigns(t, rows).withColumn("past_redemption_rate", F.when(F.col("past_campaigns_received") > 0, F.col("past_campaigns_redeemed") / F.col("past_campaigns_received")))


def _demographics(t: Tables, rows: DataFrame) -> DataFrame:
    """Labels and their codes of each row, which are looked up before the row has all its numbers."""
    return rows.select(*KEY).join(t.demographics, "household_key", "left").join(demographic_codes(t), "household_key", "left").fillna(0, [f"{c}_code" for c in LABELS])


def demographic_codes(t: Tables) -> DataFrame:
    """Each label as one more than the number it ends in, or its place among the segments; what is not listed is 0."""
    # The order of the segments.
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    listed = F.create_map(*[x for i, s in enumerate(segments) for x in (F.lit(s), F.lit(i + 1))])
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("int") + 1
    code = lambda c: F.coalesce(listed[F.col(c)] if c == "marital" else number(c), F.lit(0)).cast("long").alias(f"{c}_code")
    return t.demographics.select("household_key", *map(code, LABELS))


def features(t: Tables, household: int, campaign: int, cutoff_day: int) -> DataFrame:
    """The profile of one household for one campaign at any cutoff."""
    row = t.transactions.sparkSession.range(1).select(F.lit(household).cast("long").alias("household_key"), F.lit(campaign).cast("long").alias("campaign"), F.lit(cutoff_day).cast("long").alias("cutoff_day"))
    return profiles(t, row)
