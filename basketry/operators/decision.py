"""The decision table and the marketers' questions to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import LABELS, Tables

PAIR = ["household_key", "campaign"]


def in_use_rows(predictions: DataFrame) -> DataFrame:
    """The default candidate's rows; it stops at locked rows, no rows, several candidates or repeated rows."""
    rows = predictions.where("is_default")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("locked")).alias("locked"), F.count_distinct("candidate_id").alias("c")).first()
    if not seen["n"] or seen["locked"] or seen["c"] != 1:
        raise ValueError(f"{seen['n']} default rows, {seen['locked']} locked, {seen['c']} candidates")
    if not rows.groupBy(*PAIR).count().where("count > 1").isEmpty():
        raise ValueError("a household has two default rows in a campaign")
    return rows


def decision_table(response: DataFrame, uplift: DataFrame, t: Tables) -> DataFrame:
    """One row for each household and campaign that either model scores.

    response: PAIR, p_redeem, spend_if_redeem, redeemed. uplift: PAIR, uplift, mailed, bought.
    """
    both = response.join(uplift, PAIR, "full").join(F.broadcast(t.campaigns), "campaign", "left").join(t.demographics, "household_key", "left")
    return both.withColumn("expected_revenue", F.col("p_redeem") * F.col("spend_if_redeem")).withColumn("length_days", F.col("end_day") - F.col("start_day") + 1).withColumn("has_demographics", F.coalesce(*LABELS).isNotNull())


def campaign_categories(t: Tables) -> DataFrame:
    return t.campaign_products().join(t.products, "product_id").where("commodity is not null").groupBy("campaign", F.col("commodity").alias("category")).agg(F.count(F.lit(1)).alias("products"))


def category_redemptions(t: Tables) -> DataFrame:
    """Redemptions of each household by category; a coupon of several categories counts in each."""
    kinds = t.coupons.join(t.products, "product_id").where("commodity is not null").select("campaign", "coupon_upc", F.col("commodity").alias("category")).distinct()
    return t.redemptions.join(kinds, ["campaign", "coupon_upc"]).groupBy("household_key", "category").agg(F.count(F.lit(1)).alias("redemptions"))


def matching(table: DataFrame, measure: str | None = None, campaign: int | None = None, filters: dict[str, list[str]] | None = None) -> DataFrame:
    conditions: list[Column] = [F.col(k).isin(*v) for k, v in (filters or {}).items()]
    if measure:
        conditions.append(F.col(measure).isNotNull())
    if campaign is not None:
        conditions.append(F.col("campaign") == campaign)
    return reduce(DataFrame.where, conditions, table)


def summary(rows: DataFrame, measure: str) -> DataFrame:
    g = rows.agg(F.count_distinct("household_key").alias("households"), F.count(F.lit(1)).alias("pairs"), F.avg(measure).alias("average"), F.avg("redeemed").alias("actual"))
    return g.withColumn("small_group", F.col("households") < 30)


def top(rows: DataFrame, measure: str, n: int | None = None, share: float | None = None) -> DataFrame:
    """The best households, smaller keys first among equals: a number of them, or a share (rounded up)."""
    if share is not None:
        n = -(-int(round(rows.count() * share * 10**9)) // 10**9)
    return rows.orderBy(F.desc(measure), "household_key").limit(n).select("household_key", "campaign", measure, "redeemed")


def top_reach(rows: DataFrame, measure: str, n: int) -> DataFrame:
    """Expected total of the top list, how many of it redeemed, and how many a random list would have."""
    best = top(rows, measure, n).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"), F.sum("redeemed").alias("reached"))
    every = rows.agg(F.count(F.lit(1)).alias("n_all"), F.sum("redeemed").alias("all_redeemed"))
    return best.crossJoin(every).withColumn("at_random", F.col("all_redeemed") * F.col("n") / F.col("n_all"))


def by_segment(rows: DataFrame, measure: str, trait: str) -> DataFrame:
    return rows.where(F.col(trait).isNotNull()).groupBy(trait).agg(F.count_distinct("household_key").alias("households"), F.avg(measure).alias("average"), F.avg("redeemed").alias("actual"))


def compare(table: DataFrame, measure: str, groups: dict[str, dict[str, list[str]]], campaign: int | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [summary(matching(table, measure, campaign, f), measure).withColumn("group", F.lit(name)) for name, f in groups.items()])


def by_category(table: DataFrame, redemptions: DataFrame, campaign: int | None = None, filters: dict[str, list[str]] | None = None, n: int = 10) -> DataFrame:
    """Share of a group that ever redeemed in each category, beside all comparable households; the n largest."""
    group = matching(table, None, campaign, filters).select("household_key").distinct()
    base = (table.where("has_demographics") if filters else table).select("household_key").distinct()
    count = lambda who, name: redemptions.join(who, "household_key", "left_semi").groupBy("category").agg(F.count_distinct("household_key").alias(name))
    sizes = group.agg(F.count(F.lit(1)).alias("n_group")).crossJoin(base.agg(F.count(F.lit(1)).alias("n_base")))
    both = count(group, "in_group").join(count(base, "in_base"), "category").crossJoin(F.broadcast(sizes))
    out = both.select("category", "in_group", (F.col("in_group") / F.col("n_group")).alias("share"), (F.col("in_base") / F.col("n_base")).alias("base_share"))
    return out.withColumn("times", F.col("share") / F.col("base_share")).orderBy(F.desc("in_group"), "category").limit(n)


def category_segment(table: DataFrame, redemptions: DataFrame, category: str, trait: str) -> DataFrame:
    homes = table.where(F.col(trait).isNotNull()).select("household_key", trait).distinct()
    hit = redemptions.where(F.col("category") == category).select("household_key", F.lit(1).alias("hit")).distinct()
    return homes.join(hit, "household_key", "left").groupBy(trait).agg(F.count(F.lit(1)).alias("households"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def household(table: DataFrame, key: int) -> DataFrame:
    return table.where(F.col("household_key") == key)


def campaign_card(table: DataFrame, categories: DataFrame, campaign: int, measures: list[str]) -> DataFrame:
    """Type, length, number of categories, and how many rows each measure covers."""
    g = table.where(F.col("campaign") == campaign).groupBy("campaign", "campaign_type", "length_days").agg(*[F.count(m).alias(f"n_{m}") for m in measures])
    return g.join(categories.groupBy("campaign").agg(F.count(F.lit(1)).alias("n_categories")), "campaign", "left")


def find_category(categories: DataFrame, word: str, most: int = 5) -> DataFrame:
    """Categories that contain a word; if none does, the nearest by edit distance."""
    c = categories.select("category").distinct().withColumn("hit", F.lower("category").contains(word.lower()))
    any_hit = c.agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("any_hit"))
    near = c.crossJoin(any_hit).withColumn("distance", F.when(F.col("hit"), 0).otherwise(F.levenshtein(F.lower("category"), F.lit(word.lower()))))
    return near.where(F.col("hit") | ~F.col("any_hit")).orderBy("distance", "category").limit(most).select("category")


def score_histogram(table: DataFrame, measure: str, bins: int = 10) -> DataFrame:
    """Rows in equal-width bins from the least to the greatest score."""
    ends = table.agg(F.min(measure).alias("lo"), F.max(measure).alias("hi"))
    bin_ = F.least(F.floor((F.col(measure) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("long")
    return table.where(F.col(measure).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def population_breakdown(table: DataFrame, measure: str, trait: str) -> DataFrame:
    """Mean score by trait value, in the natural order of the values' numbers."""
    g = table.where(F.col(trait).isNotNull()).groupBy(trait).agg(F.avg(measure).alias("average"))
    return g.orderBy(F.regexp_extract(trait, r"(\d+)", 1).try_cast("int"), trait)


def type_departments(t: Tables, n: int = 6) -> DataFrame:
    """The departments with most products in each campaign type."""
    g = t.campaign_products().join(F.broadcast(t.campaigns), "campaign").join(t.products, "product_id").groupBy("campaign_type", "department").agg(F.count_distinct("product_id").alias("products"))
    place = F.row_number().over(Window.partitionBy("campaign_type").orderBy(F.desc("products"), "department"))
    return g.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def type_scores(table: DataFrame, measure: str) -> DataFrame:
    return table.groupBy("campaign_type").agg(F.avg(measure).alias("average"), F.count_distinct("campaign").alias("campaigns"))


def per_campaign_scores(table: DataFrame, measures: list[str]) -> DataFrame:
    return table.groupBy("campaign").agg(*[F.avg(m).alias(m) for m in measures])


def dataset_facts(t: Tables) -> DataFrame:
    hit = t.redemptions.select(*PAIR).distinct().withColumn("hit", F.lit(1))
    m = t.mailings.select(*PAIR).distinct().join(hit, PAIR, "left").join(F.broadcast(t.campaigns), "campaign")
    return m.groupBy("campaign_type").agg(F.count(F.lit(1)).alias("mailings"), F.count_distinct("household_key").alias("households"), F.count_distinct("campaign").alias("campaigns"), F.count("hit").alias("redeemed"))


def campaign_products(t: Tables) -> DataFrame:
    return t.campaign_products().join(t.products, "product_id", "left").where("department is not null and commodity is not null").select("campaign", "department", "commodity").distinct()


def wasted_products(uplift: DataFrame, n: int = 8) -> DataFrame:
    """Products of two campaigns or more that were bought without redemptions most."""
    g = uplift.groupBy("product_id").agg(F.count_if(F.col("n_without_redemption") > 0).alias("n_campaigns"), F.sum("n_without_redemption").alias("n_without"))
    return g.where("n_campaigns >= 2").orderBy(F.desc("n_without"), "product_id").limit(n)


def product_text_search(products: DataFrame, word: str) -> DataFrame:
    return products.where(F.lower(F.concat_ws(" ", "department", "commodity", "brand")).contains(word.lower()))
