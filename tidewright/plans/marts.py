"""Serving views over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rate_pct, version_status
from ..operators.trips import orders_of_couriers


def _dollars(c: Column) -> Column:
    """Cents, perhaps a mean of them, in dollars; whole cents are rounded first, so that halves are exact."""
    return F.round(c) / 100


def _revenue() -> list[Column]:
    c = F.col("order_total_cents")
    return [
        F.count(F.lit(1)).alias("order_count"), F.sum(c).alias("total_revenue_cents"), _dollars(F.sum(c)).alias("total_revenue_dollars"),
        _dollars(F.avg(c)).alias("avg_order_value_dollars"), F.sum("item_count").alias("total_items_sold"),
    ]


def revenue_by_kitchen_day(fact_order: DataFrame, dim_date: DataFrame, dim_kitchen: DataFrame) -> DataFrame:
    """Aggregated to (date, kitchen) keys before the dimensions are joined, so the joins see few rows."""
    net = F.sum(F.when(~F.col("is_cancelled"), F.col("order_total_cents")).otherwise(0)).alias("net_revenue_cents")
    return kitchen_day(fact_order.groupBy("date_key", "kitchen_key").agg(*_revenue(), F.count_if("is_cancelled").alias("cancelled_orders"), net), dim_date, dim_kitchen)


def kitchen_day(g: DataFrame, dim_date: DataFrame, dim_kitchen: DataFrame) -> DataFrame:
    """Sums by (date, kitchen) key with the names of both, in the view's order."""
    d = dim_date.select("date_key", F.col("full_date").alias("order_date"), "year", "month", "day_of_month", "is_weekend")
    k = dim_kitchen.select("kitchen_key", "kitchen_id", F.col("name").alias("kitchen_name"), "city", "state")
    return g.join(d, "date_key").join(k, "kitchen_key").drop("date_key", "kitchen_key").orderBy(F.desc("order_date"), F.desc("total_revenue_cents"))


def revenue_by_brand_day(fact_order: DataFrame, dim_date: DataFrame, dim_brand: DataFrame) -> DataFrame:
    return brand_day(fact_order.groupBy("date_key", "brand_key", "platform").agg(*_revenue(), F.count_distinct("customer_hk").alias("unique_customers")), dim_date, dim_brand)


def brand_day(g: DataFrame, dim_date: DataFrame, dim_brand: DataFrame) -> DataFrame:
    """Sums by (date, brand, platform) key with the names of both, in the view's order."""
    d = dim_date.select("date_key", F.col("full_date").alias("order_date"), "year", "month")
    b = dim_brand.select("brand_key", "brand_id", "brand_name", "cuisine_type")
    return g.join(d, "date_key").join(b, "brand_key").drop("date_key", "brand_key").orderBy(F.desc("order_date"), F.desc("total_revenue_cents"))


def _mean(column: str, digits: int) -> Column:
    """Mean of values with ``digits`` decimals, rounded as often; summed as integers, so exact in any order."""
    return F.round(F.avg(F.round(F.col(column) * 10**digits).cast("long"))) / 10**digits


def delivery_by_zone(trips: DataFrame, fact_order: DataFrame, dim_zone: DataFrame) -> DataFrame:
    o = orders_of_couriers(fact_order).select("order_id", "zone_key")
    z = dim_zone.select("zone_key", "zone_id", "zone_name", "city")
    t = trips.filter("duration_minutes >= 0").join(o, "order_id").join(z, "zone_key")
    m, r = F.col("duration_minutes"), F.round
    return t.groupBy("zone_id", "zone_name", "city").agg(
        F.count("trip_key").alias("trip_count"), _mean("duration_minutes", 2).alias("avg_duration_minutes"), r(F.min(m), 2).alias("min_duration_minutes"),
        r(F.max(m), 2).alias("max_duration_minutes"), _mean("distance_km", 3).alias("avg_distance_km"), _mean("avg_speed_kmh", 2).alias("avg_speed_kmh"),
    ).orderBy("avg_duration_minutes")


def _lifetime(fact_order: DataFrame) -> DataFrame:
    c = F.col("order_total_cents")
    return fact_order.groupBy("customer_hk").agg(F.count(F.lit(1)).alias("total_orders"), F.sum(c).alias("lifetime_value_cents"), _dollars(F.sum(c)).alias("lifetime_value_dollars"), _dollars(F.avg(c)).alias("avg_order_value_dollars"), F.size(F.collect_set("kitchen_key")).cast("long").alias("kitchens"), F.size(F.collect_set("brand_key")).cast("long").alias("brands"), F.max("order_placed_ts").alias("last_order_ts"))


PROFILE = ["customer_hk", "customer_id", "email_masked", "platform_count", "platforms_list", "is_multi_platform", "first_order_date"]


def multi_platform_customers(dim_customer: DataFrame, fact_order: DataFrame) -> DataFrame:
    c = dim_customer.filter("is_multi_platform and is_current").select(*PROFILE)
    out = c.join(_lifetime(fact_order).select("customer_hk", "total_orders", "lifetime_value_cents", "lifetime_value_dollars"), "customer_hk", "left")
    return out.withColumn("total_orders", F.coalesce("total_orders", F.lit(0))).orderBy(F.desc("lifetime_value_cents"))


def top_customers(dim_customer: DataFrame, fact_order: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` customers with the most orders; ties by value, then by key. Customers are ranked by a
    semi-join alone; only those at the top get their profile."""
    order = (F.desc("total_orders"), F.desc("lifetime_value_cents"), "customer_hk")
    current = dim_customer.filter("is_current")
    best = _lifetime(fact_order).join(current.select("customer_hk"), "customer_hk", "left_semi").orderBy(*order).limit(n)
    return current.select(*PROFILE).join(F.broadcast(best), "customer_hk").select(*best.columns, *PROFILE[1:]).orderBy(*order)


def menu_price_history(dim_menu_item: DataFrame) -> DataFrame:
    c = F.col
    return dim_menu_item.select("item_id", "item_name", "brand", "category", c("price").alias("price_dollars"), F.round(c("price") * 100).cast("long").alias("price_cents"), c("valid_from").alias("effective_start"), c("valid_to").alias("effective_end"), "is_current", version_status(c("valid_to")).alias("version_status")).orderBy("item_id", F.desc("effective_start"))


def sensor_anomalies(fact_sensor_hourly: DataFrame, dim_kitchen: DataFrame) -> DataFrame:
    k = dim_kitchen.select("kitchen_id", F.col("name").alias("kitchen_name"), "city")
    s = fact_sensor_hourly.filter("anomaly_count > 0").join(k, "kitchen_id")
    return s.select("kitchen_id", "kitchen_name", "city", "sensor_id", "sensor_type", "zone", F.to_date("hour").alias("sensor_date"), F.hour("hour").alias("sensor_hour"), "reading_count", "anomaly_count", rate_pct(F.col("anomaly_count"), F.col("reading_count")).alias("anomaly_rate_pct"), "avg_value", "min_value", "max_value").orderBy(F.desc("anomaly_count"), F.desc("sensor_date"))


def register(views: dict[str, DataFrame]) -> None:
    """Make views available to SQL under their names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
