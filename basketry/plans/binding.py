"""The retail tables as views of the driver's star schema, for Spark and, in the same words, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import LABELS, Tables, week_of

WEEKS, STORES = 345, 10


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cents = lambda e: F.round(e * 100).cast("long")
    lines = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = (F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) + 1).cast("long")
    transactions = lines.select(
        F.col("o_custkey").alias("household_key"), F.col("o_orderkey").alias("basket_id"), day.alias("day"), week_of(day).alias("week_no"),
        F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % STORES + 1).alias("store_id"), F.col("l_quantity").cast("long").alias("quantity"),
        cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales_cents"), (-cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("retail_disc_cents"),
        F.when(F.col("l_returnflag") == "R", -100).otherwise(0).cast("long").alias("coupon_disc_cents"),
    )
    start = (700 + 70 * F.col("n_nationkey")).cast("long")
    campaigns = read("nation").select(
        (F.col("n_nationkey") + 1).cast("long").alias("campaign"),
        F.when(F.col("n_regionkey") == 0, "A").when(F.col("n_regionkey") == 3, "C").otherwise("B").alias("campaign_type"),
        start.alias("start_day"), (start + F.when(F.col("n_regionkey") == 3, 90).otherwise(32 + 7 * F.col("n_regionkey"))).cast("long").alias("end_day"),
    )
    few = small(campaigns)
    part, campaign = read("part"), F.col("campaign")
    coupons = part.join(few, (F.col("p_partkey") * 7 + campaign * 3) % 5 == 0).select(
        "campaign", F.col("p_partkey").alias("product_id"), F.concat(F.lit("U"), campaign.cast("string"), F.lit("_"), (F.col("p_partkey") % 5).cast("string")).alias("coupon_upc")
    )
    customer = read("customer")
    mailings = customer.join(few, (F.col("c_custkey") * 11 + campaign * 17) % 10 < 3).select(F.col("c_custkey").alias("household_key"), "campaign", F.when(F.col("campaign") % 5 == 1, "A").otherwise("B").alias("mailed_type"))
    residue = (F.col("product_id") * 31 + F.col("store_id") * 17) % 23
    causal = (  # dealt by product before it grows, which serves groupings and joins by product
        part.select(F.col("p_partkey").alias("product_id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "product_id").select("product_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(STORES).cast("long"))).alias("store_id"))
        .select("product_id", "store_id", F.explode(F.sequence(F.when(residue == 0, 23).otherwise(residue), F.lit(WEEKS).cast("long"), F.lit(23).cast("long"))).alias("week_no"))
        .select("*", F.when((F.col("product_id") + F.col("store_id") + F.col("week_no")) % 3 == 0, "1").otherwise("0").alias("display"), F.when((F.col("product_id") + 3 * F.col("store_id") + F.col("week_no")) % 4 == 0, "A").otherwise("0").alias("mailer"))
    )
    products = part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("department"), F.col("p_brand").alias("commodity"), F.col("p_brand").alias("brand"))
    k = F.floor(F.col("c_custkey") / 3).cast("long")
    label = lambda word, n: F.concat(F.lit(word), (k % n).cast("string"))
    values = (label("age", 5), F.col("c_mktsegment"), label("inc", 7), label("home", 2), label("comp", 4), label("size", 6), label("kid", 3))
    demographics = customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("household_key"), *[v.alias(n) for n, v in zip(LABELS, values, strict=True)])
    return Tables(transactions, campaigns, coupons, mailings, redemptions_of(transactions, few, coupons, mailings), causal, products, demographics)


def redemptions_of(transactions: DataFrame, campaigns: DataFrame, coupons: DataFrame, mailings: DataFrame) -> DataFrame:
    """Coupon lines with a coupon of a running campaign that was mailed. campaigns: as small() returns them.

    Coupons know their campaign's days before lines meet them: otherwise the search for mailings is moved before the
    days are compared, and all campaigns of a line's product are dealt by household.
    """
    dated = coupons.join(campaigns.drop("campaign_type"), "campaign")
    return (
        transactions.where("coupon_disc_cents < 0").join(dated, "product_id").where("day between start_day and end_day")
        .join(mailings, ["household_key", "campaign"], "left_semi").select("household_key", "day", "coupon_upc", "campaign")
    )


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to broadcast, after its rows are counted; operators broadcast the campaign table on the strength of this check."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a campaign table of over {most} rows is not broadcast")
    return F.broadcast(df)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("household_key"))


#: The same views for the SQL that queries are compared with.
VIEWS = {
    "tx": """SELECT o_custkey AS household_key, o_orderkey AS basket_id, (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 1)::BIGINT AS day,
        ceil((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) + 3) / 7.0)::BIGINT AS week_no, l_partkey AS product_id, (l_suppkey % 10 + 1)::BIGINT AS store_id,
        l_quantity::BIGINT AS quantity, round(l_extendedprice * (1 - l_discount) * 100)::BIGINT AS sales_cents, (-round(l_extendedprice * l_discount * 100))::BIGINT AS retail_disc_cents,
        (CASE WHEN l_returnflag = 'R' THEN -100 ELSE 0 END)::BIGINT AS coupon_disc_cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "campaigns": """SELECT (n_nationkey + 1)::BIGINT AS campaign, CASE WHEN n_regionkey = 0 THEN 'A' WHEN n_regionkey = 3 THEN 'C' ELSE 'B' END AS campaign_type,
        (700 + 70 * n_nationkey)::BIGINT AS start_day, (700 + 70 * n_nationkey + CASE WHEN n_regionkey = 3 THEN 90 ELSE 32 + 7 * n_regionkey END)::BIGINT AS end_day FROM nation""",
    "coupons": """SELECT campaign, p_partkey AS product_id, 'U' || campaign || '_' || (p_partkey % 5) AS coupon_upc FROM part, campaigns WHERE (p_partkey * 7 + campaign * 3) % 5 = 0""",
    "mailings": """SELECT c_custkey AS household_key, campaign, CASE WHEN campaign % 5 = 1 THEN 'A' ELSE 'B' END AS mailed_type FROM customer, campaigns WHERE (c_custkey * 11 + campaign * 17) % 10 < 3""",
    "redemptions": """SELECT t.household_key, t.day, c.coupon_upc, c.campaign FROM tx t JOIN coupons c ON c.product_id = t.product_id JOIN campaigns k ON k.campaign = c.campaign AND t.day BETWEEN k.start_day AND k.end_day
        JOIN mailings m ON m.household_key = t.household_key AND m.campaign = c.campaign WHERE t.coupon_disc_cents < 0""",
    "causal": """SELECT p_partkey AS product_id, s.store_id::BIGINT AS store_id, w.week_no::BIGINT AS week_no, CASE WHEN (p_partkey + s.store_id + w.week_no) % 3 = 0 THEN '1' ELSE '0' END AS display,
        CASE WHEN (p_partkey + 3 * s.store_id + w.week_no) % 4 = 0 THEN 'A' ELSE '0' END AS mailer FROM part, range(1, 11) s(store_id), range(1, 346) w(week_no) WHERE w.week_no % 23 = (p_partkey * 31 + s.store_id * 17) % 23""",
    "products": """SELECT p_partkey AS product_id, p_type AS department, p_brand AS commodity, p_brand AS brand FROM part""",
    "demographics": """SELECT c_custkey AS household_key, 'age' || ((c_custkey // 3) % 5) AS age, c_mktsegment AS marital, 'inc' || ((c_custkey // 3) % 7) AS income, 'home' || ((c_custkey // 3) % 2) AS homeowner,
        'comp' || ((c_custkey // 3) % 4) AS composition, 'size' || ((c_custkey // 3) % 6) AS size, 'kid' || ((c_custkey // 3) % 3) AS kids FROM customer WHERE c_custkey % 3 = 0""",
    "cprod": "SELECT DISTINCT campaign, product_id FROM coupons",
}


def sql(body: str, **more: str) -> str:
    """A query over the views, and over more named ones."""
    views = {**VIEWS, **more}
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in views.items()) + "\n" + body
