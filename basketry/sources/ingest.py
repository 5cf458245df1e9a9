"""Validated loading of raw tables, and sinks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """What a raw table must look like. Column names are matched without case."""

    schema: T.StructType
    keys: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    drop_exact_duplicates: bool = False
    extra: dict = field(default_factory=dict)


def _spec(columns: str, **more) -> TableSpec:
    return TableSpec(T.StructType.fromDDL(columns), **more)


def raw_specs() -> dict[str, TableSpec]:
    """The specifications of the eight raw tables; they need an active session to be parsed."""
    # Columns, keys and required columns of the raw files.
    return {
        "transaction_data": _spec("household_key long, BASKET_ID long, DAY long, PRODUCT_ID long, QUANTITY long, SALES_VALUE double, STORE_ID long, RETAIL_DISC double, TRANS_TIME long, WEEK_NO long, COUPON_DISC double, COUPON_MATCH_DISC double", required=("household_key", "PRODUCT_ID", "BASKET_ID")),
        "hh_demographic": _spec("classification_1 string, classification_2 string, classification_3 string, homeowner_desc string, classification_5 string, classification_4 string, kid_category_desc string, household_key long", keys=("household_key",), required=("household_key",)),
        "product": _spec("PRODUCT_ID long, MANUFACTURER string, DEPARTMENT string, BRAND string, COMMODITY_DESC string, SUB_COMMODITY_DESC string, CURR_SIZE_OF_PRODUCT string", keys=("PRODUCT_ID",), required=("PRODUCT_ID",)),
        "campaign_table": _spec("DESCRIPTION string, household_key long, CAMPAIGN long", keys=("household_key", "CAMPAIGN"), required=("household_key", "CAMPAIGN")),
        "campaign_desc": _spec("DESCRIPTION string, CAMPAIGN long, START_DAY long, END_DAY long", keys=("CAMPAIGN",), required=("CAMPAIGN", "START_DAY", "END_DAY")),
        "coupon": _spec("COUPON_UPC string, PRODUCT_ID long, CAMPAIGN long", required=("COUPON_UPC", "PRODUCT_ID", "CAMPAIGN"), drop_exact_duplicates=True),
        "coupon_redempt": _spec("household_key long, DAY long, COUPON_UPC string, CAMPAIGN long", required=("household_key", "COUPON_UPC", "CAMPAIGN")),
        "causal_data": _spec("PRODUCT_ID long, STORE_ID long, WEEK_NO long, display string, mailer string", keys=("PRODUCT_ID", "STORE_ID", "WEEK_NO"), required=("PRODUCT_ID", "STORE_ID", "WEEK_NO")),
    }


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, so that codes keep their leading zeros; types come from the specification."""
    return spark.read.option("header", True).csv(path)


def schema_match(raw: DataFrame, spec: TableSpec) -> tuple[DataFrame | None, list[str], list[str]]:
    """Columns renamed to the specification's names and order, with what is missing and what is not expected."""
    have = {c.lower(): c for c in raw.columns}
    want = [f.name for f in spec.schema]
    missing = [c for c in want if c.lower() not in have]
    unexpected = [c for low, c in have.items() if low not in {w.lower() for w in want}]
    if missing:
        return None, missing, unexpected
    return raw.select(*[F.col(f"`{have[c.lower()]}`").alias(c) for c in want]), missing, unexpected


def typed_cast(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, dict[str, int]]:
    """Cast column by column. A column with a value that its type cannot hold stays as it is, with the number of such values."""
    types = {f.name: f.dataType for f in spec.schema}
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()]).first().asDict()
    failed = {c: n for c, n in bad.items() if n}
    return df.select(*[(F.col(c) if c in failed else F.col(c).try_cast(t)).alias(c) for c, t in types.items()]), failed


def null_counts(df: DataFrame, columns) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.selectExpr("stack({}, {}) AS (`column`, n_null)".format(len(columns), ", ".join(f"'{c}', `{c}`" for c in columns)))


def repeated_keys(df: DataFrame, keys) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n_repeated"))


def drop_null_required(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns)) if columns else df


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def load_and_validate(spark: SparkSession, path: str, name: str, spec: TableSpec) -> tuple[DataFrame | None, DataFrame]:
    """The clean table and a one-row report. Repeated keys are reported and do not change the status; a missing file does."""
    columns = "`table` string, status string, n_raw long, n_clean long, n_null_dropped long, n_duplicates_removed long, n_repeated_keys long, problems array<string>"
    report = lambda *row: spark.createDataFrame([row], columns)
    try:
        raw = scan_csv(spark, path)
    except Exception as e:  # the reader's own error for a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None, report(name, "MISSING", None, None, None, None, None, ["no such file"])
    matched, missing, unexpected = schema_match(raw, spec)
    if matched is None:
        return None, report(name, "SCHEMA_MISMATCH", raw.count(), None, None, None, None, [f"missing {c}" for c in missing])
    typed, failed = typed_cast(matched, spec)
    kept = drop_null_required(typed, spec.required)
    clean = drop_exact_duplicates(kept) if spec.drop_exact_duplicates else kept
    n_raw, n_kept, n_clean = typed.count(), kept.count(), clean.count()
    n_repeated = repeated_keys(clean, spec.keys).first()[0] if spec.keys else 0
    problems = [f"unexpected {c}" for c in unexpected] + [f"{n} values of {c} are not {spec.schema[c].dataType.simpleString()}" for c, n in failed.items()]
    status = "OK_WITH_WARNINGS" if problems or n_raw != n_kept else "OK"
    return clean, report(name, status, n_raw, n_clean, n_raw - n_kept, n_kept - n_clean, int(n_repeated), problems)


def reports(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with lower-case names; only the columns asked for are read."""
    df = spark.read.parquet(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    return df.select(*columns) if columns else df


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").format(kind).option("header", True).save(path)


def keyed_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new added or laid over; a value that new does not give stays as it was."""
    values = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    given = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return o.join(n, same, "full").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], *[given(c).alias(c) for c in values])


def set_apart(transactions: DataFrame, products: DataFrame, coupons: DataFrame, is_set_apart) -> tuple[DataFrame, DataFrame]:
    """Lines of merchandise, and lines of products that the condition sets apart; a product with a coupon is never set apart."""
    apart = products.where(is_set_apart).select("product_id").join(coupons.select("product_id").distinct(), "product_id", "left_anti")
    return transactions.join(apart, "product_id", "left_anti"), transactions.join(apart, "product_id", "left_semi")
