"""Out-of-time splits and replay, from the campaign calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A campaign calendar has one row a campaign, so its windows and self joins are over those rows only.


def split_70_30(calendar: DataFrame, share: float = 0.7) -> DataFrame:
    """(campaign, part): the earliest share of campaigns train, the rest test; ids break ties."""
    n = calendar.agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy("start_day", "campaign"))
    return calendar.withColumn("place", place).crossJoin(F.broadcast(n)).select("campaign", F.when(F.col("place") <= F.floor(F.col("n") * share), "train").otherwise("test").alias("part"))


def forward_folds(calendar: DataFrame, first_test_day: int, gap: int = 0) -> DataFrame:
    """(test_campaign, cutoff_day, train_campaign, train_type): campaigns that ended before each test campaign's cutoff."""
    tests = calendar.where(F.col("start_day") >= first_test_day).select(F.col("campaign").alias("test_campaign"), (F.col("start_day") - gap).alias("cutoff_day"))
    train = calendar.selectExpr("campaign AS train_campaign", "campaign_type AS train_type", "end_day")
    return tests.join(F.broadcast(train), F.col("end_day") < F.col("cutoff_day")).drop("end_day")


def fold_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("test_campaign", "cutoff_day").agg(F.count(F.lit(1)).alias("n_train"), F.count_if(F.col("train_type") == "A").alias("n_train_type_a"))


def walk_forward(calendar: DataFrame, rows: DataFrame, least_rows: int) -> DataFrame:
    """(test_campaign, n_train_rows): campaigns whose strictly earlier ones have enough rows."""
    size = rows.groupBy("campaign").agg(F.count(F.lit(1)).alias("rows"))
    earlier = calendar.join(size, "campaign").selectExpr("start_day AS earlier_start", "rows")
    tests = calendar.selectExpr("campaign AS test_campaign", "start_day")
    return tests.join(F.broadcast(earlier), F.col("earlier_start") < F.col("start_day")).groupBy("test_campaign").agg(F.sum("rows").alias("n_train_rows")).where(F.col("n_train_rows") >= least_rows)


def inner_folds(folds: DataFrame, calendar: DataFrame, last: int = 4) -> DataFrame:
    """(test_campaign, inner_campaign): the newest training campaigns of each fold."""
    dated = folds.join(F.broadcast(calendar.selectExpr("campaign AS train_campaign", "start_day")), "train_campaign")
    newest = F.row_number().over(Window.partitionBy("test_campaign").orderBy(F.desc("start_day"), F.desc("train_campaign")))
    return dated.withColumn("newest", newest).where(F.col("newest") <= last).select("test_campaign", F.col("train_campaign").alias("inner_campaign"))


def outer_folds(folds: DataFrame, rows: DataFrame, least_rows: int, least_positives: int, locked: int = 2) -> DataFrame:
    """Folds with enough training rows and positives; the newest few are locked."""
    size = rows.groupBy("campaign").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives")).withColumnRenamed("campaign", "train_campaign")
    g = folds.join(size, "train_campaign").groupBy("test_campaign", "cutoff_day").agg(F.sum("rows").alias("n_rows"), F.sum("positives").alias("n_positives"))
    g = g.where((F.col("n_rows") >= least_rows) & (F.col("n_positives") >= least_positives))
    return g.withColumn("locked", F.row_number().over(Window.orderBy(F.desc("cutoff_day"), F.desc("test_campaign"))) <= locked)


def asof_calendar(calendar: DataFrame, day: int) -> DataFrame:
    """One row: campaigns finished, running and not started on a day, and the newest finished one."""
    finished = F.col("end_day") < day
    return calendar.agg(
        F.count_if(finished).alias("finished"), F.count_if(~finished & (F.col("start_day") <= day)).alias("running"), F.count_if(F.col("start_day") > day).alias("not_started"),
        F.max(F.when(finished, F.struct("end_day", "campaign")))["campaign"].alias("newest_finished"),
    )


def newly_finished(calendar: DataFrame, since: int, day: int) -> DataFrame:
    return calendar.where((F.col("end_day") < day) & (F.col("end_day") >= since)).select("campaign", "end_day")


def asof(rows: DataFrame, calendar: DataFrame, day: int) -> DataFrame:
    """Rows of campaigns finished by a day."""
    return rows.join(F.broadcast(calendar.where(F.col("end_day") < day).select("campaign")), "campaign", "left_semi")


def fill_blanks(rows: DataFrame, reasons: dict[str, set[str]], zero_reasons: set[str]) -> DataFrame:
    """Null to zero in columns all of whose permitted reasons mean none; a column with another reason stops it."""
    bad = {c: r - zero_reasons for c, r in reasons.items() if r - zero_reasons}
    if bad:
        raise ValueError(f"no value stands for {bad}")
    return rows.fillna(0, list(reasons))


def type_flags(rows: DataFrame) -> DataFrame:
    return rows.withColumn("is_type_a", (F.col("campaign_type") == "A").cast("long")).withColumn("is_type_b", (F.col("campaign_type") == "B").cast("long"))
