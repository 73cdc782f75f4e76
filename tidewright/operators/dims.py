"""Dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import date_key, day_part, is_weekend, mask, surrogate_key, time_key
from .upsert import insert_only


def date(spark: SparkSession, start: str = "2024-01-01", end: str = "2026-12-31") -> DataFrame:
    c = F.col("full_date")
    df = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS full_date")
    return df.select("full_date", date_key(c).alias("date_key"), F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day_of_month"), F.dayofweek(c).alias("day_of_week"), F.date_format(c, "EEEE").alias("day_name"), F.date_format(c, "MMMM").alias("month_name"), F.quarter(c).alias("quarter"), is_weekend(c).alias("is_weekend"), F.lit(False).alias("is_holiday"))


def time(spark: SparkSession) -> DataFrame:
    df = spark.range(1440).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60).alias("full_time"))
    c, h = F.col("full_time"), F.hour("full_time")
    # fixed values: the hours of lunch, dinner and happy hour
    return df.select("full_time", time_key(c).alias("time_key"), h.alias("hour"), F.minute(c).alias("minute"), day_part(h).alias("time_of_day"), h.between(11, 13).alias("is_lunch_rush"), h.between(17, 20).alias("is_dinner_rush"), h.between(16, 18).alias("is_happy_hour"))


def from_seed(seed: DataFrame, natural_key: str, key: str, newest: str | None = None) -> DataFrame:
    """A dimension whose last seed wins (SCD1), keyed by its natural key.

    Of rows that repeat a natural key the one with the greatest ``newest`` stays (a column that
    orders the seeds), ties and a missing order go by all values, so one row a key is left.
    """
    rank = F.max(F.struct(*([F.col(newest).alias("__newest")] if newest else []), *seed.columns)).alias("last")
    last = seed.dropna(subset=[natural_key]).groupBy(F.col(natural_key).alias("__key")).agg(rank)
    return last.select(surrogate_key(F.col("__key")).alias(key), *[F.col(f"last.`{c}`") for c in seed.columns])


def zone(cities: DataFrame, kinds: dict[str, float], target: DataFrame | None = None) -> DataFrame:
    """Every kind of zone in every city, written once (SCD0): known zones never change."""
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("avg_delivery_radius_km")) for k, r in kinds.items()]))
    df = cities.select("city").distinct().select("city", rows)
    df = df.withColumn("zone_id", F.concat_ws("-", "city", "kind"))
    new = df.select(surrogate_key(F.col("zone_id")).alias("zone_key"), "zone_id", F.concat_ws(" ", "city", F.initcap(F.regexp_replace("kind", "-", " "))).alias("zone_name"), "city", "avg_delivery_radius_km")
    return insert_only(target, new, ["zone_key"])


def menu_item(history: DataFrame) -> DataFrame:
    """Versions of menu items in dollars; the key names a version."""
    c = F.col
    return history.select(surrogate_key(c("brand"), c("item_id"), c("effective_start").cast("string")).alias("menu_item_key"), "item_id", c("name").alias("item_name"), (c("price_cents") / 100).alias("price"), "category", "brand", c("effective_start").alias("valid_from"), c("effective_end").alias("valid_to"), "is_current")


def customer(hub: DataFrame, bridge: DataFrame, orders: DataFrame) -> DataFrame:
    """One current row per customer, without an address: the id is the hash, the email is masked."""
    plats = bridge.groupBy("customer_hk").agg(F.count_distinct("platform").cast("int").alias("platform_count"), F.to_json(F.array_sort(F.collect_set("platform"))).alias("platforms_list"))
    first = orders.groupBy(F.col("customer_key").alias("customer_hk")).agg(F.min("order_timestamp").cast("date").alias("first_order_date"))
    c = F.col
    df = hub.join(plats, "customer_hk", "left").join(first, "customer_hk", "left")
    n = F.coalesce("platform_count", F.lit(1))
    return df.select("customer_hk", c("customer_hk").alias("customer_id"), F.coalesce(mask(c("customer_bk")), F.md5("customer_hk")).alias("email_masked"), "first_order_date", n.alias("platform_count"), "platforms_list", (n > 1).alias("is_multi_platform"), "record_source", c("load_ts").alias("effective_start"), F.lit(None).cast("timestamp").alias("effective_end"), F.lit(True).alias("is_current"))


def pairs(orders: DataFrame, kitchens: DataFrame, brands: DataFrame) -> DataFrame:
    """Kitchen-brand pairs seen in orders, as keys; pairs with an unknown member are left out."""
    seen = orders.select("kitchen_id", "brand_name").dropna().distinct()
    df = seen.join(kitchens.select("kitchen_id", "kitchen_key"), "kitchen_id").join(brands.select("brand_name", "brand_key"), "brand_name")
    return df.select("kitchen_key", "brand_key", F.lit(True).alias("is_active")).distinct()
