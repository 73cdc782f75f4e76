"""Operational checks and profiles of a pipeline's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rate_pct


def row_counts(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """Rows (table_name, n, expected, status)."""
    out = None
    for name, df in tables.items():
        want = least.get(name, 1)
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n", F.lit(want).cast("long").alias("expected"), F.when(F.col("n") >= want, "pass").otherwise("fail").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


#: The least rows that each table of the dimensional set must have.
GOLD_LEAST = {
    "dim_date": 1095, "dim_time": 1440, "dim_kitchen": 50, "dim_brand": 8, "dim_delivery_zone": 50, "dim_menu_item": 1, "dim_customer": 1, "bridge_kitchen_brand": 1,
    "fact_order": 1, "fact_sensor_hourly": 1, "fact_order_state_history": 1, "fact_delivery_trip": 1,
}


def freshness(df: DataFrame, ts: str, as_of: Column, warn_seconds: int = 7_200, fail_seconds: int = 86_400) -> DataFrame:
    age = F.unix_timestamp(as_of) - F.unix_timestamp("latest")
    one = df.agg(F.max(ts).alias("latest")).withColumn("age_seconds", age)
    return one.withColumn("status", F.when(F.col("age_seconds").isNull() | (F.col("age_seconds") > fail_seconds), "fail").when(F.col("age_seconds") > warn_seconds, "warn").otherwise("pass"))


def orphans(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, fail_pct: float = 5.0) -> DataFrame:
    """Fact rows without their dimension row; unknown members (-1) are orphans."""
    known = dim.select(F.col(dim_key).alias("k")).distinct().withColumn("hit", F.lit(1))
    j = fact.select(F.col(fact_key).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(known, "k", "left")
    one = j.agg(F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("orphans"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    pct = F.coalesce(F.round(F.col("orphans") * 100 / F.nullif("total", F.lit(0)), 2), F.lit(0.0))
    return one.select(F.lit(fact_key).alias("fk"), "orphans", "total", pct.alias("orphan_pct"), F.when(pct > fail_pct, "fail").when(F.col("orphans") > 0, "warn").otherwise("pass").alias("status"))


def grain(df: DataFrame, keys: list[str]) -> DataFrame:
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_keys"))
    n = F.coalesce("n", F.lit(0))
    return one.select(n.alias("n"), "n_keys", (n - F.col("n_keys")).alias("duplicates"), F.when(n == F.col("n_keys"), "pass").otherwise("fail").alias("status"))


def pii_scan(tables: dict[str, DataFrame], mark: str = "@") -> DataFrame:
    """Values with ``mark`` in every string column of every table, one pass each."""
    out = None
    for name, df in tables.items():
        cols = [c for c, t in df.dtypes if t == "string"]
        one = df.agg(*[F.count_if(F.col(c).contains(mark)).alias(c) for c in cols])
        one = one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("leaks")) for c in cols])))
        out = one if out is None else out.unionByName(one)
    return out


def verdict(checks: DataFrame, status: str = "status") -> DataFrame:
    """failures, warnings and the verdict over any frame of checks."""
    one = checks.agg(F.count_if(F.col(status) == "fail").alias("failures"), F.count_if(F.col(status) == "warn").alias("warnings"))
    return one.withColumn("verdict", F.when(F.col("failures") > 0, "failed").when(F.col("warnings") > 0, "warnings").otherwise("healthy"))


def count_drop(df: DataFrame, ts: str, share: float = 0.5, days: int = 7) -> DataFrame:
    """Days with fewer rows than ``share`` of the mean of the ``days`` before. Works on one row
    per day, so the ordering without a key is over the calendar and not over the data."""
    daily = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("day").rowsBetween(-days, -1)
    return daily.withColumn("trailing_avg", F.round(F.avg("n").over(w), 4)).withColumn("is_drop", F.coalesce(F.col("n") < share * F.col("trailing_avg"), F.lit(False)))


def bronze_profile(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("ingestion_date").agg(F.count(F.lit(1)).alias("n"), F.min("kafka_offset").alias("min_offset"), F.max("kafka_offset").alias("max_offset")).orderBy("ingestion_date")


def bronze_samples(bronze: DataFrame) -> DataFrame:
    """A record of every ingestion partition, the one with the smallest offset, whole: one map-side-combined
    pass over the table. A partition without records gives no row."""
    g = bronze.groupBy("ingestion_date", "ingestion_hour").agg(F.min(F.struct("kafka_offset", "kafka_timestamp", "raw_value")).alias("first"), F.count(F.lit(1)).alias("n"))
    return g.select("ingestion_date", "ingestion_hour", "n", "first.*")


def bronze_totals(bronze: DataFrame) -> DataFrame:
    """One row over the whole table: rows, range of offsets, distinct ingestion partitions."""
    part = F.struct("ingestion_date", "ingestion_hour")
    return bronze.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("kafka_offset").alias("lo"), F.max("kafka_offset").alias("hi")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("lo").alias("min_offset"), F.max("hi").alias("max_offset"), F.count(F.lit(1)).alias("n_partitions")
    )


def pass_rate(checks: DataFrame) -> DataFrame:
    """Share of the rules of each suite that hold."""
    g = checks.groupBy("suite").agg(F.count(F.lit(1)).alias("n_rules"), F.count_if("success").alias("n_passed"))
    return g.withColumn("pass_pct", rate_pct(F.col("n_passed"), F.col("n_rules")))


def platform_profile(orders: DataFrame) -> DataFrame:
    return orders.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_email").isNull()).alias("null_emails"), F.count_distinct("customer_key").alias("customers")).orderBy("platform")


def identity_profile(hub: DataFrame, bridge: DataFrame) -> DataFrame:
    by_source = hub.groupBy("record_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("customer_bk").isNull()).alias("null_emails"))
    many = bridge.filter("raw_email is not null").groupBy("raw_email").agg(F.count_distinct("platform").alias("p")).filter("p > 1").agg(F.count(F.lit(1)).alias("cross_platform_emails"))
    return by_source.crossJoin(many)  # one row on the right
