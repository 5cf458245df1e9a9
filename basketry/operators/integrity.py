"""Cross-table integrity and quality checks. Each check is one small aggregate that counts rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Tables

#: Documented promotion codes.
DISPLAY_CODES = tuple("0123456789A")
MAILER_CODES = tuple("0ACDFHJLPXZ")
#: Fixed value: a line of more pieces is flagged.
MOST_QUANTITY = 100


def counted(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return df.agg((F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n_rows"))


def not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys other lacks, counted."""
    return counted(df.join(other.select(*keys).distinct(), keys, "left_anti"))


def repeats(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each key (of whole rows without one)."""
    keys = keys or df.columns
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n_rows"))


def null_keys(tables: Tables) -> DataFrame:
    """(table, column, n_null) of the key columns."""
    keys = {"transactions": ["household_key", "product_id", "basket_id"], "coupons": ["coupon_upc", "product_id", "campaign"], "redemptions": ["household_key", "coupon_upc", "campaign"], "mailings": ["household_key", "campaign"], "campaigns": ["campaign"], "products": ["product_id"]}
    parts = []
    for name, columns in keys.items():
        row = getattr(tables, name).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        parts.append(row.selectExpr("stack({}, {}) AS (`table`, `column`, n_null)".format(len(columns), ", ".join(f"'{name}', '{c}', {c}" for c in columns))))
    return reduce(DataFrame.unionByName, parts)


def checks(t: Tables, expected_households: int | None = None) -> dict[str, tuple[str, int | None, DataFrame]]:
    """check id -> (kind, expected count, one-row frame with n_rows). Kinds: integrity, quality, info."""
    tx, households = t.transactions, t.transactions.select("household_key").distinct()
    dated = lambda df: df.join(F.broadcast(t.campaigns), "campaign")
    history = t.transactions.groupBy("household_key").agg(F.min("day").alias("first"))
    last = tx.agg(F.max("day").alias("last_day"))
    mailed_pairs = t.mailings.select("household_key", "campaign").distinct()
    other = t.campaigns.selectExpr("campaign AS other", "start_day AS other_start", "end_day AS other_end")
    noise = lambda c: (F.col(c) > 0) & (F.col(c) <= 0.5)
    typed = t.mailings if "mailed_type" in t.mailings.columns else t.mailings.withColumn("mailed_type", F.lit(None).cast("string"))  # mailings without a type contradict none
    return {
        "X0": ("integrity", 0, null_keys(t).agg(F.sum("n_null").alias("n_rows"))),
        "X1": ("integrity", expected_households, counted(households)),
        "X2a": ("integrity", 0, not_in(t.mailings, households, ["household_key"])),
        "X2b": ("integrity", 0, not_in(t.redemptions, households, ["household_key"])),
        "X2c": ("integrity", 0, not_in(t.demographics, households, ["household_key"])),
        "X3": ("integrity", 0, not_in(tx, t.products, ["product_id"])),
        "X4": ("integrity", 0, not_in(t.mailings, t.campaigns, ["campaign"])),
        "X5": ("integrity", 0, not_in(t.coupons, t.campaigns, ["campaign"])),
        "X6": ("integrity", 0, counted(dated(typed), F.col("mailed_type") != F.col("campaign_type"))),
        "X7": ("integrity", 0, not_in(t.redemptions, t.mailings, ["household_key", "campaign"])),
        "X8": ("integrity", 0, counted(dated(t.redemptions), ~F.col("day").between(F.col("start_day"), F.col("end_day")))),
        "X9": ("integrity", 0, not_in(t.redemptions, t.coupons, ["campaign", "coupon_upc"])),
        "X10a": ("info", None, counted(t.mailings)),
        "X10b": ("integrity", 0, repeats(t.mailings, ["household_key", "campaign"])),
        "X11": ("info", None, counted(mailed_pairs.join(t.redemptions.select("household_key", "campaign").distinct(), ["household_key", "campaign"], "left_semi"))),
        "X12": ("integrity", 0, counted(tx, F.ceil((F.col("day") + 2) / 7.0) != F.col("week_no"))),
        "X13": ("integrity", 0, repeats(t.products, ["product_id"])),
        "X14": ("integrity", 0, repeats(t.demographics, ["household_key"])),
        "X15": ("integrity", 0, counted(t.causal, ~F.col("display").isin(*DISPLAY_CODES) | ~F.col("mailer").isin(*MAILER_CODES))),
        "Q1": ("quality", 0, repeats(t.coupons)),
        "Q2": ("quality", 0, repeats(t.redemptions)),
        "Q3": ("quality", 0, repeats(tx)),
        "Q4a": ("quality", 0, counted(tx, F.col("retail_disc_cents") > 0.5)),
        "Q4b": ("quality", 0, counted(tx, F.col("coupon_disc_cents") > 0.5)),
        "Q4c": ("quality", 0, counted(tx, F.col("retail_disc_cents") + F.col("coupon_disc_cents") > 0.5)),
        "I5": ("info", None, counted(tx, noise("retail_disc_cents") | noise("coupon_disc_cents"))),
        "Q5": ("quality", 0, counted(tx, F.col("quantity") <= 0)),
        "Q6": ("quality", 0, counted(tx, F.col("sales_cents") <= 0)),
        "Q7": ("quality", 0, counted(tx, F.col("quantity") > MOST_QUANTITY)),
        "Q8": ("quality", 0, counted(t.campaigns.crossJoin(F.broadcast(last)), F.col("end_day") > F.col("last_day"))),
        "Q9": ("quality", 0, counted(t.causal.groupBy("product_id", "store_id", "week_no").count().where("count > 1"))),
        "I1": ("info", None, counted(dated(mailed_pairs).join(history, "household_key"), F.col("start_day") - F.col("first") < 182)),
        "I2": ("info", None, counted(t.campaigns.join(F.broadcast(other), (F.col("campaign") < F.col("other")) & (F.col("start_day") <= F.col("other_end")) & (F.col("other_start") <= F.col("end_day"))))),
        "I3": ("info", None, counted(t.coupons.groupBy("coupon_upc").agg(F.count_distinct("campaign").alias("n")).where("n > 1"))),
        "I4": ("info", None, counted(households.join(t.demographics.select("household_key").distinct(), "household_key", "left_semi"))),
    }


def finding(check_id: str, kind: str, expected: int | None, row: DataFrame) -> DataFrame:
    """One row of the findings: check_id, kind, status, n_rows."""
    n = F.col("n_rows")
    if kind == "info" or expected is None:
        status = F.lit("INFO")
    else:
        status = F.when(n == expected, "OK").otherwise("ERROR" if kind == "integrity" else "FLAG")
    return row.select(F.lit(check_id).alias("check_id"), F.lit(kind).alias("kind"), status.alias("status"), n.cast("long").alias("n_rows"))


def findings(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [finding(k, *v) for k, v in checks(t).items()])


def summary(found: DataFrame) -> DataFrame:
    """Findings by status, worst first."""
    rank = F.when(F.col("status") == "ERROR", 0).when(F.col("status") == "FLAG", 1).when(F.col("status") == "OK", 2).otherwise(3)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n_checks"), F.sum("n_rows").alias("n_rows")).orderBy(rank)


# What the assumption profile measures beyond the checks.


def profile_counts(t: Tables) -> DataFrame:
    """(measure, value): households, those never mailed, and mailings by campaign type."""
    households = t.transactions.select("household_key").distinct()
    named = lambda name, df: df.select(F.lit(name).alias("measure"), F.col("n_rows").alias("value"))
    by_type = t.mailings.join(F.broadcast(t.campaigns), "campaign").groupBy("campaign_type").count().select(F.concat(F.lit("mailings_"), "campaign_type").alias("measure"), F.col("count").alias("value"))
    return named("households", counted(households)).union(named("never_mailed", not_in(households, t.mailings, ["household_key"]))).union(by_type)


def discount_sign(t: Tables) -> DataFrame:
    columns = ["retail_disc_cents", "coupon_disc_cents"]
    row = t.transactions.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max), ("above", lambda x: F.count_if(x > 0)), ("below", lambda x: F.count_if(x < 0)))])
    stacked = ", ".join(f"'{c}', low_{c}, high_{c}, above_{c}, below_{c}" for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {stacked}) AS (`column`, low, high, n_above_zero, n_below_zero)")


def ranges(t: Tables) -> DataFrame:
    return t.transactions.agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("week_no").alias("first_week"), F.max("week_no").alias("last_week"), F.count_if(F.col("quantity") <= 0).alias("n_no_quantity"),
        F.count_if(F.col("sales_cents") <= 0).alias("n_no_sales"), F.max("quantity").alias("most_quantity"), F.max("sales_cents").alias("most_sales_cents"),
    )


def day_week(t: Tables) -> DataFrame:
    """Days that map to several weeks, and the offset k for which ceil((day + k) / 7) matches the week most often."""
    days = t.transactions.groupBy("day", "week_no").agg(F.count(F.lit(1)).alias("n"))
    several = days.groupBy("day").agg(F.count_distinct("week_no").alias("w")).agg(F.count_if(F.col("w") > 1).alias("days_in_several_weeks"))
    offsets = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).groupBy("k").agg(F.sum(F.when(F.ceil((F.col("day") + F.col("k")) / 7.0) == F.col("week_no"), F.col("n")).otherwise(0)).alias("n_match"))
    best = offsets.agg(F.max_by("k", "n_match").cast("long").alias("best_offset"), F.max("n_match").alias("n_match"))
    return several.crossJoin(best)


def campaign_order(t: Tables) -> DataFrame:
    """Each pair of overlapping campaigns, and whether ids follow start days up to the first one."""
    before = F.lag("start_day").over(Window.orderBy("campaign"))
    c = t.campaigns.withColumn("in_order", F.coalesce(F.col("start_day") >= before, F.lit(True)))
    o = t.campaigns.selectExpr("campaign AS other", "start_day AS other_start", "end_day AS other_end")
    pairs = c.join(F.broadcast(o), (F.col("campaign") < F.col("other")) & (F.col("start_day") <= F.col("other_end")) & (F.col("other_start") <= F.col("end_day")))
    return pairs.select("campaign", "other", "in_order", (F.col("start_day") <= F.col("end_day")).alias("valid_window"))


def coupon_pool(t: Tables) -> DataFrame:
    """Least, median and most coupons of a campaign, by type."""
    n = t.coupons.groupBy("campaign").agg(F.count_distinct("coupon_upc").alias("n"))
    return n.join(F.broadcast(t.campaigns), "campaign").groupBy("campaign_type").agg(F.min("n").alias("least"), F.median("n").alias("median"), F.max("n").alias("most"))


def history(t: Tables) -> DataFrame:
    first = t.transactions.groupBy("household_key").agg(F.min("day").alias("first"))
    days = t.mailings.join(F.broadcast(t.campaigns), "campaign").join(first, "household_key").select((F.col("start_day") - F.col("first")).alias("d"))
    return days.agg(F.count_if(F.col("d") <= 0).alias("n_none"), F.count_if(F.col("d") < 56).alias("n_below_56"), F.count_if(F.col("d") < 182).alias("n_below_182"), F.median("d").alias("median"), F.min("d").alias("least"), F.max("d").alias("most"))


def categories(t: Tables) -> DataFrame:
    """How often each label has each value, null included."""
    from ..schema import LABELS

    stacked = ", ".join(f"'{c}', {c}" for c in LABELS)
    return t.demographics.selectExpr(f"stack({len(LABELS)}, {stacked}) AS (label, value)").groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))


def promotion_codes(t: Tables) -> DataFrame:
    key = ["product_id", "store_id", "week_no"]
    per = t.causal.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return t.causal.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("display").alias("n_display"), F.count_distinct("mailer").alias("n_mailer")).crossJoin(per.agg(F.count_if(F.col("n") > 1).alias("n_repeated_keys")))


def match_formula(t: Tables) -> DataFrame:
    """Lines with a shop's own coupon discount: how many, the share whose sales less that discount exceed the sales, and both sums. No line gives a null share and sums."""
    lines = t.transactions.where("match_disc_cents < 0")
    above = F.avg((F.col("sales_cents") - F.col("match_disc_cents") > F.col("sales_cents")).cast("double"))
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), above.alias("share_above"), F.sum("sales_cents").alias("sales_cents"), F.sum("match_disc_cents").alias("match_disc_cents"))


def input_checks(t: Tables, grid: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, actual, expected, passed): rows of the grid with mailed_flag and redeemed_flag, and lines whose week breaks the rule of days. passed is null for counts without an expected value."""
    both = (F.col("mailed_flag") == 1) & (F.col("redeemed_flag") == 1)
    of_grid = grid.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("mailed_flag") == 1).alias("mailed_rows"), F.count_if(both).alias("redeemed_mailed_rows"))
    weeks = t.transactions.agg(F.count_if(F.ceil((F.col("day") + 2) / 7.0) != F.col("week_no")).alias("weeks_off_rule"))
    names = ["rows", "mailed_rows", "redeemed_mailed_rows", "weeks_off_rule"]
    wanted = {"weeks_off_rule": 0, **expected}
    stacked = ", ".join(f"'{n}', {n}, CAST({wanted.get(n, 'NULL')} AS BIGINT)" for n in names)
    return of_grid.crossJoin(weeks).selectExpr(f"stack({len(names)}, {stacked}) AS (name, actual, expected)").withColumn("passed", F.col("actual") == F.col("expected"))  # one row each


def stop_on_failure(checked: DataFrame) -> None:
    """Raise if a row of input_checks did not pass."""
    failed = [r["name"] for r in checked.where("not passed").collect()]  # of four rows at most
    if failed:
        raise ValueError(f"input checks failed: {', '.join(failed)}")
