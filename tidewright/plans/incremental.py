"""Revenue views kept up to date by signed changes: what an order was is taken back, what it is now is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import marts

KITCHEN_DAY, BRAND_DAY = ["date_key", "kitchen_key"], ["date_key", "brand_key", "platform"]

def _measures() -> dict[str, Column]:
    """What is summed of an order; all sums can be taken back."""
    c = F.col
    return {
        "order_count": F.lit(1), "total_revenue_cents": c("order_total_cents"), "total_items_sold": c("item_count"),
        "cancelled_orders": c("is_cancelled").cast("int"), "net_revenue_cents": F.when(~c("is_cancelled"), c("order_total_cents")).otherwise(0),
    }


def deltas(before: DataFrame | None, after: DataFrame, keys: list[str]) -> DataFrame:
    """Signed sums by ``keys`` of changed orders: ``after`` holds their rows now, ``before`` those that the
    stored sums contain. An order that moves to another key is taken from the one and given to the other."""
    signed = after.withColumn("__sign", F.lit(1))
    if before is not None:
        signed = signed.unionByName(before.withColumn("__sign", F.lit(-1)).select(*signed.columns))
    return signed.groupBy(*keys).agg(*[F.sum(v * F.col("__sign")).cast("long").alias(n) for n, v in _measures().items()])


def merge(stored: DataFrame | None, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The stored sums after a delta: one aggregation over two small tables, no order is read. A key
    whose orders are all gone is left out."""
    if stored is None:
        return delta.filter("order_count <> 0")
    names = [n for n in stored.columns if n not in keys]
    both = stored.unionByName(delta.select(*stored.columns))
    return both.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names]).filter("order_count <> 0")


def kitchen_day_view(stored: DataFrame, dim_date: DataFrame, dim_kitchen: DataFrame) -> DataFrame:
    """The view of ``marts.revenue_by_kitchen_day`` over stored sums."""
    return marts.kitchen_day(_with_means(stored), dim_date, dim_kitchen)


def brand_day_view(stored: DataFrame, dim_date: DataFrame, dim_brand: DataFrame) -> DataFrame:
    """The view of ``marts.revenue_by_brand_day`` over sums stored by (date, brand, platform, customer):
    with the customer in the key, a customer's last order can be taken back and distinct customers
    are rows."""
    sums = ["order_count", "total_revenue_cents", "total_items_sold"]
    g = stored.groupBy(*BRAND_DAY).agg(*[F.sum(n).alias(n) for n in sums], F.count_if(F.col("customer_hk").isNotNull()).alias("unique_customers"))
    return marts.brand_day(_with_means(g), dim_date, dim_brand)


def _with_means(sums: DataFrame) -> DataFrame:
    cents = F.col("total_revenue_cents")
    return sums.withColumns({"total_revenue_dollars": F.round(cents) / 100, "avg_order_value_dollars": F.round(cents / F.col("order_count")) / 100})
