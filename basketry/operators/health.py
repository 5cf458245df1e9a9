"""The feature table, its checks, and the leak test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import LABELS, Tables
from . import outcomes, profile, spine

PAIR = ["household_key", "campaign"]
SHARES = ("share_spend_on_discount_26w", "coupon_trip_share_26w", "campaign_product_share_26w", "past_redemption_rate", "campaign_promo_share")
#: The reasons for which a value may be null, as conditions on the row.
REASONS = {
    "no_history": "no_history_flag = 1", "no_recent_spend": "spend_per_week_26w = 0 or no_history_flag = 1", "none_received": "past_campaigns_received = 0", "type_a": "campaign_type = 'A'",
    "not_redeemed": "redeemed_flag = 0", "no_demographics": "has_demographics = 0",
}
BLANK_WHEN = {
    **dict.fromkeys(("spend_per_week_8w", "spend_per_week_26w", "trips_per_week_8w", "trips_per_week_26w", "days_since_last_trip", "n_departments_26w", "coupon_lines_per_week_26w", "coupon_lines_per_week_8w", "coupon_lines_per_week_all", "coupon_commodities_26w", "campaign_product_spend_per_week_26w",
                     "campaign_product_coupon_lines_per_week_26w", "campaign_commodity_coupon_lines_per_week_26w"), ("no_history",)),
    **dict.fromkeys(("avg_basket_value_26w", "share_spend_on_discount_26w", "campaign_product_share_26w", "coupon_trip_share_26w"), ("no_recent_spend",)),
    **dict.fromkeys(("past_redemption_rate", "redeemed_last_campaign"), ("none_received",)),
    **dict.fromkeys(("bought_excl_display_flyer", "bought_excl_display", "bought_without_redemption"), ("type_a",)),
    "campaign_promo_share": ("type_a", "no_history"), "redeemed_coupon_product_spend_during": ("not_redeemed",), **dict.fromkeys(LABELS, ("no_demographics",)),
}


def feature_table(t: Tables, gap: int = 0) -> DataFrame:
    """Grid, profile at the cutoff, and outcomes: one row for each household and campaign. Columns carry their permitted reasons for null as metadata."""
    rows = spine.spine(t)
    made = profile.profiles(t, profile.cutoffs(rows, gap)).drop("cutoff_day")
    out = rows.join(made, PAIR, "left").join(outcomes.outcome_table(t, rows), PAIR, "left")
    return out.select(*[F.col(c).alias(c, metadata={"blank_when": list(BLANK_WHEN.get(c, ()))}) for c in out.columns])


def chosen_rows(t: Tables, where: str) -> DataFrame:
    """Rows of spine.redeemed(), with mailed_overlapping_campaign if the filter names it, that pass the filter."""
    rows = spine.redeemed(t)
    return (outcomes.with_overlap(t, rows) if "mailed_overlapping_campaign" in where else rows).where(where)


def features_of_rows(t: Tables, rows: DataFrame, numbers: list[str], labels: list[str], keep=lambda df, name: df) -> DataFrame:
    """feature_table() for chosen grid rows and columns: profiles and outcomes of other rows are never made.

    keep: (table, name) -> the same rows, stored, so that each step has a plan of its own.
    """
    out = rows
    for name in labels:
        out = outcomes.outcome(t, out, name)
    if out is not rows:
        out = keep(out, "labelled")
    # by the profile's whole key, by which its parts are dealt already: its many columns are not dealt again
    made = profile.profiles_of(t, profile.cutoffs(rows), numbers).select(*profile.KEY, *numbers)
    return out.withColumn("cutoff_day", F.col("start_day")).join(made.hint("merge"), profile.KEY, "left").drop("cutoff_day")


def _stacked(row: DataFrame, columns: list[str], parts: list[str], names: str) -> DataFrame:
    items = ", ".join(f"'{c}', " + ", ".join(f"`{p}_{c}`" for p in parts) for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {items}) AS ({names})")


def unexplained_blanks(table: DataFrame, blank_when: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(column, n_null, n_unexplained): nulls that no permitted reason of the column explains."""
    blank_when = BLANK_WHEN if blank_when is None else blank_when
    columns = [c for c in table.columns if c not in PAIR]
    excused = lambda c: reduce(Column.__or__, [F.expr(REASONS[r]) for r in blank_when.get(c, ())], F.lit(False))
    row = table.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns], *[F.count_if(F.col(c).isNull() & ~F.coalesce(excused(c), F.lit(False))).alias(f"u_{c}") for c in columns])
    return _stacked(row, columns, ["n", "u"], "`column`, n_null, n_unexplained")


def column_health(table: DataFrame) -> DataFrame:
    """(column, share_blank, n_distinct, least, most) of every number, from one pass for the shares and one for each count of distinct values."""
    columns = [f.name for f in table.schema if isinstance(f.dataType, T.NumericType) and f.name not in PAIR]
    items = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    long = table.selectExpr(f"stack({len(columns)}, {items}) AS (`column`, x)")
    per_value = long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg((F.sum(F.when(F.col("x").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share_blank"), F.count("x").alias("n_distinct"), F.min("x").alias("least"), F.max("x").alias("most"))


def output_checks(table: DataFrame, rows: DataFrame) -> DataFrame:
    """(check, n_bad): repeated keys, changed grid columns, negative numbers, shares outside of 0 to 1."""
    shared = [c for c in rows.columns if c in table.columns]
    numbers = [f.name for f in table.schema if isinstance(f.dataType, T.NumericType) and f.name not in ("history_days_before_start",)]
    below = reduce(Column.__or__, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in numbers])
    outside = reduce(Column.__or__, [F.coalesce(~F.col(c).between(0, 1), F.lit(False)) for c in SHARES])
    repeated = table.groupBy(*PAIR).count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    changed = rows.select(*shared).exceptAll(table.select(*shared)).agg(F.count(F.lit(1)).alias("changed"))
    one = table.agg(F.count_if(below).alias("negative"), F.count_if(outside).alias("outside")).crossJoin(repeated).crossJoin(changed)
    return one.selectExpr("stack(4, 'repeated_key', repeated, 'changed', changed, 'negative', negative, 'share_outside', outside) AS (`check`, n_bad)")


def model_table(table: DataFrame, where: str, features: list[str], labels: list[str]) -> DataFrame:
    """Rows of one model: keys, features and labels. A label among the features, or a repeated key, stops it."""
    if set(features) & set(labels):
        raise ValueError(f"labels among features: {sorted(set(features) & set(labels))}")
    out = table.where(where).select(*PAIR, "campaign_type", "start_day", *features, *labels)
    if not out.groupBy(*PAIR).count().where("count > 1").isEmpty():
        raise ValueError("a household has two rows in a campaign")
    return out


#: Row filters of the three models.
MODEL_ROWS = {
    1: "mailed_flag = 1", 2: "redeemed_flag = 1 and campaign_type <> 'A'",
    3: "campaign_type <> 'A' and (mailed_flag = 1 or mailed_overlapping_campaign = 0)",
}


def scramble_future(t: Tables, cutoff: int, seed: int = 0) -> Tables:
    """Tables whose lines and redemptions on or after a day are moved to other households by a seeded hash; earlier ones stay."""
    households = t.transactions.select("household_key").distinct()
    # a permutation within the households of one hash range needs no order over all of them
    part = F.pmod(F.xxhash64("household_key", F.lit(seed)), F.lit(64))
    order = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("household_key", F.lit(seed + 1)), "household_key"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("household_key"))
    both = households.withColumn("part", part).withColumn("a", order).withColumn("b", place)
    swap = both.select("part", "household_key", "a").join(both.select("part", F.col("household_key").alias("_to"), F.col("b").alias("a")), ["part", "a"]).select("household_key", "_to")

    def moved(df: DataFrame) -> DataFrame:
        later = df.where(F.col("day") >= cutoff).join(swap, "household_key").withColumn("household_key", F.col("_to")).drop("_to")
        return df.where(F.col("day") < cutoff).unionByName(later.select(*df.columns))

    return t.with_(transactions=moved(t.transactions), redemptions=moved(t.redemptions))


EXCHANGED = 100_000


def leak_test(t: Tables, build, columns: list[str], keep=lambda df, name: df) -> DataFrame:
    """(column, n_changed): how many values of a feature change, over all households and campaigns, when the days from the campaign's start on are scrambled. build: (tables, rows) -> features.

    Each campaign has a world of its own, in which later lines and redemptions belong to other households; households are
    numbered anew in each world, so all worlds are built as one. Lines are dealt twice, to their own household and to the one
    that their later days go to, and only then repeated for the worlds, where that no longer takes an exchange. Lines,
    redemptions and mailings of a world know its cutoff_day, the only one that their household is asked for.
    keep: (table, name) -> the same rows, stored.
    """
    worlds = t.campaigns.select(F.col("campaign").alias("_world"), F.col("start_day").alias("_cutoff"), F.row_number().over(Window.orderBy("campaign")).cast("long").alias("_place"))  # a row a campaign
    n = t.campaigns.count()
    coded = F.col("household_key") * (n + 1) + F.col("_place")
    households = keep(t.transactions.select("household_key").distinct(), "households")
    # each household's later days go to the next one of its hash part, the last one's to the first; parts have about EXCHANGED households
    part = F.pmod(F.xxhash64("household_key"), F.lit(households.count() // EXCHANGED + 1))
    ring = Window.partitionBy("part").orderBy(F.xxhash64("household_key", F.lit(5)), "household_key")
    first = F.first("household_key").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    swap = households.withColumn("part", part).select("household_key", F.coalesce(F.lead("household_key").over(ring), first).alias("_to"))

    def dealt(df: DataFrame, name: str) -> DataFrame:
        later = df.join(swap, "household_key", "left").withColumn("household_key", F.coalesce("_to", "household_key")).select(*df.columns, F.lit(True).alias("_later"))
        return keep(df.withColumn("_later", F.lit(False)).unionByName(later).repartition("household_key"), name)

    def everywhere(df: DataFrame) -> DataFrame:
        x = df.crossJoin(F.broadcast(worlds))  # worlds: the checked campaign table
        if "_later" in df.columns:
            x = x.where(F.coalesce(F.col("day") >= F.col("_cutoff"), F.lit(False)) == F.col("_later")).drop("_later")
        return x.withColumn("household_key", coded).withColumnRenamed("_cutoff", "cutoff_day").drop("_world", "_place")

    others = t.with_(
        transactions=everywhere(dealt(t.transactions, "dealt_lines")), redemptions=everywhere(dealt(t.redemptions, "dealt_redemptions")),
        mailings=everywhere(t.mailings), demographics=everywhere(t.demographics).drop("cutoff_day"),
    )
    rows = households.crossJoin(F.broadcast(worlds)).select("household_key", F.col("_world").alias("campaign"), F.col("_cutoff").alias("cutoff_day"), coded.alias("_coded"))
    after = build(others, rows.select(F.col("_coded").alias("household_key"), "campaign", "cutoff_day"))
    after = keep(after.select(F.floor(F.col("household_key") / (n + 1)).alias("household_key"), "campaign", "cutoff_day", *[F.col(c).alias(f"_{c}") for c in columns]), "after")
    before = build(t, rows.drop("_coded")).select(*profile.KEY, *columns)
    row = before.join(after.hint("merge"), profile.KEY).agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"n_{c}") for c in columns])
    return _stacked(row, columns, ["n"], "`column`, n_changed")


def top_signals(table: DataFrame, columns: list[str], outcome: str, n: int = 3) -> DataFrame:
    """The columns that tell a yes/no outcome best, alone."""
    from .analyses import signal_screen

    found = signal_screen(table.where(F.col(outcome).isNotNull()), columns, outcome)
    return found.orderBy(F.desc("auc"), "column").limit(n)
