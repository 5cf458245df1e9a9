"""Outlier fences and line flags. A line keeps its own values; corrections stand in columns beside them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOLERANCE = 0.5  # cents
LEAST_REFERENCE, LEAST_NORMAL, LEAST_ELIGIBLE = 5, 100, 20
K_MILD, K_EXTREME, K_TYPO = 1.5, 3.0, 1.5
#: Accuracy of the sketch that names a range around each quantile, and how far on either side of it that range reaches.
ACCURACY, MARGIN = 10_000, 0.0005


def nonmerch_flag(lines: DataFrame, products: DataFrame, departments: tuple[str, ...], commodities: tuple[str, ...]) -> DataFrame:
    """Lines with is_non_merchandise and no_department. The product table must have one row a product."""
    p = products.select("product_id", F.trim(F.coalesce("department", F.lit(""))).alias("_d"), F.trim(F.coalesce("commodity", F.lit(""))).alias("_c"))
    if not p.groupBy("product_id").count().where("count > 1").isEmpty():
        raise ValueError("product_id is not unique in the product table")
    j = lines.join(p, "product_id", "left").fillna("", ["_d", "_c"])
    return j.withColumn("is_non_merchandise", F.col("_d").isin(*departments) | F.col("_c").isin(*commodities)).withColumn("no_department", F.col("_d") == "").drop("_d", "_c")


def nonmerch_mix(lines: DataFrame, products: DataFrame, top: int = 6) -> DataFrame:
    """The most frequent department and commodity pairs of non-merchandise lines."""
    return lines.where("is_non_merchandise").join(products, "product_id").groupBy("department", "commodity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "department", "commodity").limit(top)


def fields(lines: DataFrame) -> DataFrame:
    """One row a line and field that is eligible for an outlier test: line columns, field, value."""
    merchandise = ~F.col("is_non_merchandise")
    q, s = F.col("quantity").cast("double"), F.col("sales_cents").cast("double")
    value = lambda name, ok, v: F.when(merchandise & ok, F.struct(F.lit(name).alias("field"), v.alias("value")))
    each = F.array(
        value("quantity", q > 0, q), value("sales", s > 0, s), value("unit_price", (q > 0) & (s > 0), s / q),
        value("retail_disc", F.col("retail_disc_cents") < 0, -F.col("retail_disc_cents").cast("double")), value("coupon_disc", F.col("coupon_disc_cents") < 0, -F.col("coupon_disc_cents").cast("double")),
    )
    return lines.withColumn("_f", F.explode(each)).where("_f is not null").select("*", "_f.field", "_f.value").drop("_f")


def quantiles(values: DataFrame, value: str, by: list[str], asked: list[tuple[float, Callable[[Column], Column] | None]]) -> DataFrame:
    """(by, n, q): the number of a group's values that are not null, and its exact quantiles, interpolated as percentile() does.

    asked: shares, each with the increasing function on whose scale neighbours are interpolated, None for their own.
    No task has a group's values: a sketch names a range around each quantile; values inside one are counted by value,
    all others by the gap that they fall into. A sketch that were further off than it may be stops the query.
    """
    x = values.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    around = [min(1.0, max(0.0, share + m)) for share, _ in asked for m in (-MARGIN, MARGIN)]
    cuts = x.groupBy(*by).agg(F.percentile_approx("_v", around, ACCURACY).alias("_cuts"))
    ranges = [(F.col("_cuts")[2 * i], F.col("_cuts")[2 * i + 1]) for i in range(len(asked))]
    inside = reduce(Column.__or__, [F.col("_v").between(low, high) for low, high in ranges])
    gap = sum(((F.col("_v") >= low).cast("int") for low, _ in ranges), F.lit(0))
    counted = x.join(F.broadcast(cuts), by).groupBy(*by, F.when(inside, F.col("_v")).alias("_point"), F.when(~inside, gap).alias("_gap"))  # cuts: a row a group
    counted = counted.agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    group = Window.partitionBy(*by)
    so_far = group.orderBy("_least").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_end", F.sum("_n").over(so_far)).withColumn("_all", F.sum("_n").over(group)).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(place: Column) -> Column:
        lost = F.raise_error(F.lit("a quantile is outside of the range that its sketch named")).cast("double")
        found = F.when((F.col("_least") == F.col("_most")) | (place == F.col("_start")), F.col("_least")).when(place == F.col("_end") - 1, F.col("_most")).otherwise(lost)
        return F.max(F.when((place >= F.col("_start")) & (place < F.col("_end")), found))

    place = [(F.col("_all") - 1) * F.lit(share) for share, _ in asked]
    ends = placed.groupBy(*by).agg(F.max("_all").alias("n"), *[at(f(p)).alias(f"_{name}{i}") for i, p in enumerate(place) for name, f in (("low", F.floor), ("high", F.ceil))])

    def between(i: int, share: float, scale) -> Column:
        p = (F.col("n") - 1) * F.lit(share)
        low, high = (scale(F.col(f"_{name}{i}")) if scale else F.col(f"_{name}{i}") for name in ("low", "high"))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return ends.select(*by, "n", F.array(*[between(i, *a) for i, a in enumerate(asked)]).alias("q"))


def fences(values: DataFrame, k_mild: float = K_MILD, k_extreme: float = K_EXTREME) -> DataFrame:
    """Fences of each field on the logarithmic scale; where the middle half is one value, percentiles instead. Fields with too few values have none."""
    found = quantiles(values, "value", ["field"], [(0.25, F.ln), (0.75, F.ln), *[(share, None) for share in (0.001, 0.01, 0.99, 0.999)]])
    g = found.select("field", F.col("n").alias("n_eligible"), F.slice("q", 1, 2).alias("q"), F.slice("q", 3, 4).alias("p"))
    iqr = F.col("q")[1] - F.col("q")[0]
    spread = iqr > 1e-9
    fence = lambda q, k, p: F.when(spread, F.exp(F.col("q")[q] + k * iqr)).otherwise(F.col("p")[p])
    return g.where(F.col("n_eligible") >= LEAST_ELIGIBLE).select(
        "field", "n_eligible", F.when(spread, "iqr_log").otherwise("percentile").alias("method"), fence(0, -k_mild, 1).alias("mild_low"), fence(1, k_mild, 2).alias("mild_high"),
        fence(0, -k_extreme, 0).alias("extreme_low"), fence(1, k_extreme, 3).alias("extreme_high"), F.col("p")[3].alias("p99_9"),
    )


def levels(values: DataFrame, limits: DataFrame) -> DataFrame:
    """values with level_high and level_low: 0 none, 1 mild, 2 extreme. Discounts have the extreme high level only; only unit prices have a low one."""
    v, x = F.col("value"), values.join(F.broadcast(limits), "field")  # limits: one row for each of five fields
    size = F.col("field").isin("retail_disc", "coupon_disc")
    high = F.when(v > F.col("extreme_high"), 2).when(~size & (v > F.col("mild_high")), 1).otherwise(0)
    low = F.when(F.col("field") != "unit_price", 0).when(v < F.col("extreme_low"), 2).when(v < F.col("mild_low"), 1).otherwise(0)
    return x.withColumn("level_high", high.cast("long")).withColumn("level_low", low.cast("long"))


def sensitivity(values: DataFrame, limits: DataFrame, old_limit: float = 100) -> DataFrame:
    """(field, rule, n_flagged, n_eligible) of each rule."""
    v, x = F.col("value"), values.join(F.broadcast(limits), "field")
    rules = {"mild_high": v > F.col("mild_high"), "extreme_high": v > F.col("extreme_high"), "mild_low": v < F.col("mild_low"), "extreme_low": v < F.col("extreme_low"), "p99_9": v > F.col("p99_9"), "old_fixed": (F.col("field") == "quantity") & (v > old_limit)}
    g = x.groupBy("field").agg(F.count(F.lit(1)).alias("n_eligible"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    return g.selectExpr("field", "n_eligible", "stack({}, {}) AS (rule, n_flagged)".format(len(rules), ", ".join(f"'{n}', {n}" for n in rules)))


#: A line's distances from what is usual, and from how many of them on a fence stands.
LEAST_OF = {"share": LEAST_NORMAL, "unit": 1, "sales": 1}


def _upper_fences(known: DataFrame) -> DataFrame:
    """One row: _share_fence, _unit_fence and _sales_fence of lines that know what is usual for their product; null where too few lines have the distance."""
    q, s, d = F.col("quantity"), F.col("sales_cents"), F.col("retail_disc_cents")
    distances = {"share": F.when(d < -TOLERANCE, -d / (s - d)), "unit": F.abs(F.ln(s / q / F.col("_unit"))), "sales": F.abs(F.ln(s / F.col("_sales")))}
    each = F.array(*[F.struct(F.lit(k).alias("distance"), v.alias("value")) for k, v in distances.items()])
    found = quantiles(known.where((q > 0) & (s > 0)).select(F.explode(each).alias("_d")).select("_d.*"), "value", ["distance"], [(0.25, None), (0.75, None)])
    fence = lambda k, least: F.max(F.when((F.col("distance") == k) & (F.col("n") >= least), F.col("q")[1] + K_TYPO * (F.col("q")[1] - F.col("q")[0])))
    return found.agg(*[fence(k, least).alias(f"_{k}_fence") for k, least in LEAST_OF.items()])


def line_flags(lines: DataFrame, keep=lambda df, name: df) -> DataFrame:
    """lines with flags of odd discounts, quantities and sales, which of them look like a typo, and corrected values.

    A positive discount is a typo if, flipped, its share of the shelf price is within the fence of
    normal lines; a negative quantity if, flipped, the unit price is within the fence of what is usual for
    the product; a zero quantity with money if the money is. Products with too few
    normal lines have nothing usual. keep: (table, name) -> the same rows, stored: lines with what is usual are read three times.
    """
    q, s, d, c = F.col("quantity"), F.col("sales_cents"), F.col("retail_disc_cents"), F.col("coupon_disc_cents")
    usual = lines.where((q > 0) & (s > 0)).groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"), F.median(s / q).alias("_unit"), F.median(s.cast("double")).alias("_sales"), F.median(q.cast("double")).alias("_quantity"))
    known = keep(lines.join(usual, "product_id", "left"), "usual")
    x = known.crossJoin(F.broadcast(_upper_fences(known)))  # one row
    noise = lambda v: (v > 0) & (v <= TOLERANCE)
    positive = d > TOLERANCE
    adjustment = positive & (q <= 0)
    odd_discount = positive & (q > 0)
    money = (q <= 0) & (s > TOLERANCE) & ~adjustment
    no = F.lit(False)
    discount_typo = F.coalesce(odd_discount & (s + d > 0) & (d / (s + d) <= F.least("_share_fence", F.lit(1.0))), no)
    enough = F.coalesce(F.col("_n") >= LEAST_REFERENCE, no)
    sign_typo = F.coalesce(money & (q < 0) & enough & (F.abs(F.ln(s / F.abs(q) / F.col("_unit"))) <= F.col("_unit_fence")), no)
    missing = F.coalesce(money & (q == 0) & enough & (F.abs(F.ln(s / F.col("_sales"))) <= F.col("_sales_fence")), no)
    flags = {
        "flag_positive_retail_disc": positive, "flag_discount_rounding_noise": noise(d) | noise(c), "flag_adjustment_line": adjustment, "flag_discount_sign_typo": discount_typo,
        "flag_positive_discount_unexplained": odd_discount & ~discount_typo, "flag_nonpositive_qty": q <= 0, "flag_nonpositive_sales": s <= 0, "flag_zero_line": (q <= 0) & (s <= 0), "flag_free_item": (q > 0) & (s <= 0),
        "flag_qty_sign_typo": sign_typo, "flag_qty_missing_money_ok": missing, "flag_qty_nonpos_with_sales": money & ~sign_typo & ~missing, "flag_sales_rounding_noise": (q <= 0) & noise(s) & ~adjustment,
    }
    out = x.select(*lines.columns, *[v.alias(k) for k, v in flags.items()], F.col("_quantity"), enough.alias("_enough"))
    use_median = F.col("flag_qty_missing_money_ok") & F.col("_enough")
    out = out.withColumn("retail_disc_corrected", F.when(F.col("flag_discount_sign_typo"), -F.abs(d))).withColumn("quantity_corrected", F.when(F.col("flag_qty_sign_typo"), F.abs(q)))
    out = out.withColumn("quantity_imputed", F.when(use_median, F.col("_quantity")).when(F.col("flag_qty_missing_money_ok"), 1.0))
    return out.withColumn("quantity_imputed_source", F.when(use_median, "product_median").when(F.col("flag_qty_missing_money_ok"), "default_1")).drop("_quantity", "_enough")


def flag_stats(flagged: DataFrame) -> DataFrame:
    """(flag, n) for every flag column, from one pass."""
    names = [c for c in flagged.columns if c.startswith("flag_")]
    row = flagged.agg(*[F.count_if(F.col(c)).alias(c) for c in names])
    return row.selectExpr("stack({}, {}) AS (flag, n)".format(len(names), ", ".join(f"'{c}', {c}" for c in names)))


OLD_LIMIT = 100


def level_table(values: DataFrame, limits: DataFrame, key: list[str]) -> DataFrame:
    """One row a line that has a field in values: key and out_<field>, the worse of its high and low level."""
    names = ["quantity", "sales", "unit_price", "retail_disc", "coupon_disc"]
    worst = F.greatest("level_high", "level_low")
    return levels(values, limits).groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("field") == n, worst)), F.lit(0)).cast("long").alias(f"out_{n}") for n in names])


def merge_levels(flagged: DataFrame, level_rows: DataFrame, key: list[str], old_limit: int = OLD_LIMIT) -> DataFrame:
    """flagged with the out_ columns of level_rows, extreme_any and have_outliers.

    The tables line up if both have the same keys, each once. If they do not, the levels are
    left out: have_outliers is false, and flag_qty_outlier is the old rule of quantities above old_limit.
    """
    sides = flagged.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(level_rows.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    apart = sides.groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> 1 or b <> 1")
    if not apart.isEmpty():
        return flagged.withColumn("flag_qty_outlier", F.col("quantity") > old_limit).withColumn("have_outliers", F.lit(False))
    out = [c for c in level_rows.columns if c.startswith("out_")]
    extreme = F.greatest(*out) == 2 if len(out) > 1 else F.col(out[0]) == 2
    return flagged.join(level_rows, key).withColumn("extreme_any", extreme).withColumn("have_outliers", F.lit(True))


def merge_stats(merged: DataFrame, old_limit: int = OLD_LIMIT) -> DataFrame:
    """One row of counts over merge_levels' rows; big_qty is by the old rule."""
    big, non_merch, no_department = F.col("quantity") > old_limit, F.col("is_non_merchandise"), F.col("no_department")
    extreme = F.count_if("extreme_any") if "extreme_any" in merged.columns else F.lit(None).cast("long")
    return merged.agg(
        F.coalesce(F.bool_and("have_outliers"), F.lit(False)).alias("have_outliers"), F.count_if(non_merch).alias("non_merch"), F.count_if(big).alias("big_qty"), F.count_if(big & non_merch).alias("big_qty_non_merch"),
        F.count_if(no_department).alias("no_dept"), F.count_if(no_department & F.col("flag_zero_line")).alias("no_dept_zero_line"), extreme.alias("extreme_any"),
    )
