"""The retail tables that operators take."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

#: The labels of a household.
LABELS = ("age", "marital", "income", "homeowner", "composition", "size", "kids")


@dataclass(frozen=True)
class Tables:
    """Lazy frames. Days are integers; money is in whole cents, so that sums do not depend on their order.

    transactions: household_key, basket_id, day, week_no, product_id, store_id, quantity, sales_cents, retail_disc_cents, coupon_disc_cents
    campaigns:    campaign, campaign_type, start_day, end_day (a closed interval)
    coupons:      campaign, product_id, coupon_upc
    mailings:     household_key, campaign, and mailed_type if the mailing names the type of its campaign
    redemptions:  household_key, day, coupon_upc, campaign
    causal:       product_id, store_id, week_no, display, mailer
    products:     product_id, department, commodity, brand
    demographics: household_key and LABELS
    """

    transactions: DataFrame
    campaigns: DataFrame
    coupons: DataFrame
    mailings: DataFrame
    redemptions: DataFrame
    causal: DataFrame
    products: DataFrame
    demographics: DataFrame

    def campaign_products(self) -> DataFrame:
        return self.coupons.select("campaign", "product_id").distinct()

    def with_(self, **frames: DataFrame) -> Tables:
        return replace(self, **frames)


def week_of(day):
    from pyspark.sql import functions as F

    return F.ceil((day + 2) / 7.0).cast("long")
