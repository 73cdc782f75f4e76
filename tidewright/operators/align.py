"""Alignment of heterogeneous order feeds to one schema, in one pass over the raw text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_email, dollars_to_cents, identity_key, is_late, item_count, order_key
from .dedup import dedup_first

ITEM = "array<struct<item_id:string,name:string,price:double,qty:int>>"


@dataclass(frozen=True)
class FeedMapping:
    """Where a platform keeps each canonical field. ``in_cents``: its total is integer cents."""

    platform: str
    customer_id: str
    email: str
    total: str
    ts: str
    kitchen: str
    brand: str
    items: str
    zone: str
    in_cents: bool = False


#: The field names of the three order shapes.
MAPPINGS = (
    FeedMapping("uber_eats", "customer_uid", "customer_email", "total_amount", "order_timestamp", "kitchen_id", "brand_name", "items", "delivery_zone"),
    FeedMapping("doordash", "dasher_customer_id", "customer_email", "order_value", "created_at", "store_id", "store_name", "line_items", "drop_off_zone"),
    FeedMapping("own_app", "user_id", "email", "amount_cents", "timestamp", "kitchen_id", "brand", "items", "zone", in_cents=True),
)


def payload_schema(mappings: tuple[FeedMapping, ...] = MAPPINGS) -> str:
    """One struct with the fields of every shape, so that a record is parsed once. Numbers and
    times are read as text and converted tolerantly: a malformed one is null, never an error."""
    fields = {"order_id", "platform", "event_type", "status", "status_timestamp", "kitchen_id", "reason"}
    for m in mappings:
        fields |= {m.customer_id, m.email, m.total, m.ts, m.kitchen, m.brand, m.zone, m.items}
    return ", ".join(f"`{f}` string" for f in sorted(fields))


def parse(bronze: DataFrame, mappings: tuple[FeedMapping, ...] = MAPPINGS, schema: str | None = None) -> DataFrame:
    """The fields of every record (or those in ``schema``) under ``p``. A generator keeps filters on the fields above the
    parsing: pushed below it they would each parse the record again."""
    return bronze.select("*", F.explode(F.array(F.from_json("raw_value", schema or payload_schema(mappings)))).alias("p"))


def _pick(field: str, mappings: tuple[FeedMapping, ...]) -> Column:
    out = F.lit(None).cast("string")
    for m in mappings:
        out = F.when(F.col("p.platform") == m.platform, F.col(f"p.`{getattr(m, field)}`")).otherwise(out)
    return out


def _received(bronze: DataFrame, mappings: tuple[FeedMapping, ...]) -> DataFrame:
    """The fields of placed orders as they came, under one name each."""
    df = parse(bronze, mappings).filter(F.col("p.event_type").isNull() & F.col("p.platform").isin(*[m.platform for m in mappings]))
    pick = lambda field: _pick(field, mappings)
    cents = F.lit(None).cast("long")
    for m in mappings:
        number = F.col(f"p.`{m.total}`")
        value = number.try_cast("long") if m.in_cents else dollars_to_cents(number.try_cast("double"))
        cents = F.when(F.col("p.platform") == m.platform, value).otherwise(cents)
    return df.select(
        F.col("p.platform").alias("platform"),
        pick("customer_id").alias("platform_customer_id"),
        pick("email").alias("email"),
        cents.alias("order_total_cents"),
        F.try_to_timestamp(pick("ts")).alias("order_timestamp"),
        pick("kitchen").alias("kitchen_id"),
        pick("brand").alias("brand_name"),
        pick("zone").alias("zone_id"),
        pick("items").alias("items_json"),
        F.col("p.order_id").alias("order_id"),
        "ingestion_timestamp",
        "kafka_offset",
    )


def _canonical(raw: DataFrame) -> DataFrame:
    c = F.col
    return raw.select(
        identity_key(c("email"), c("platform"), c("platform_customer_id")).alias("customer_key"),
        "order_total_cents",
        "order_timestamp",
        "kitchen_id",
        "brand_name",
        "platform",
        "platform_customer_id",
        order_key(c("platform"), c("order_id")).alias("platform_order_id"),
        "items_json",
        item_count(F.from_json("items_json", ITEM)).alias("item_count"),
        clean_email(c("email")).alias("raw_email"),
        "zone_id",
        "ingestion_timestamp",
        is_late(c("order_timestamp"), c("ingestion_timestamp")).alias("is_late_arriving"),
        "kafka_offset",
    )


def placed_orders(bronze: DataFrame, mappings: tuple[FeedMapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical orders of all platforms, duplicates included; status changes are no orders."""
    return _canonical(_received(bronze, mappings))


def align(bronze: DataFrame, mappings: tuple[FeedMapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical orders, the earliest record of each order kept (broker offset breaks ties). Keys and
    hashes are made of the records that stay, so that they are not shuffled."""
    first = dedup_first(_received(bronze, mappings), ["platform", "order_id"], ["order_timestamp", "ingestion_timestamp", "kafka_offset"])
    return _canonical(first).drop("kafka_offset")


def status_events(bronze: DataFrame, mappings: tuple[FeedMapping, ...] = MAPPINGS) -> DataFrame:
    """Placed and changed states of every order: order_id (canonical key), status, status_timestamp, kitchen_id, reason.

    One pass and one parse: a record without an event type is a placed order in its platform's
    shape, a status change has the common one. The earliest record of a state counts.
    """
    c = F.col
    fields = {"order_id", "platform", "event_type", "status", "status_timestamp", "kitchen_id", "reason"} | {f for m in mappings for f in (m.ts, m.kitchen)}
    df = parse(bronze, mappings, ", ".join(f"`{f}` string" for f in sorted(fields)))
    placed = c("p.event_type").isNull() & c("p.platform").isin(*[m.platform for m in mappings])
    changed = c("p.event_type") == "status_change"
    df = df.filter(placed | changed).select(
        order_key(c("p.platform"), c("p.order_id")).alias("order_id"),
        F.when(placed, "placed").otherwise(c("p.status")).alias("status"),
        F.try_to_timestamp(F.when(placed, _pick("ts", mappings)).otherwise(c("p.status_timestamp"))).alias("status_timestamp"),
        F.when(placed, _pick("kitchen", mappings)).otherwise(c("p.kitchen_id")).alias("kitchen_id"),
        F.when(changed, c("p.reason")).alias("reason"),
    )
    # dealt by order first: few states are repeats, so nothing is gained by gathering them before the shuffle, and the
    # states of an order stay together in what is written
    return df.filter(c("status_timestamp").isNotNull()).repartition("order_id").groupBy("order_id", "status").agg(F.min("status_timestamp").alias("status_timestamp"), F.min("kitchen_id").alias("kitchen_id"), F.min_by("reason", "status_timestamp").alias("reason"))


def faults(bronze: DataFrame, mappings: tuple[FeedMapping, ...] = MAPPINGS) -> DataFrame:
    """``bronze`` plus ``fault``: why a record becomes neither an order nor a state, null if it does.

    not_json, unknown_platform, unknown_event, no_order_id, bad_timestamp, no_status or bad_total; the first
    that holds counts. Split by it: good records go on, the others to a quarantine table.
    """
    c = F.col
    df = parse(bronze, mappings)
    fields = [f"p.`{f.name}`" for f in df.schema["p"].dataType.fields]
    pick = lambda field: _pick(field, mappings)
    status = c("p.event_type") == "status_change"
    placed = c("p.event_type").isNull()
    cents = F.lit(None).cast("long")
    for m in mappings:
        number = c(f"p.`{m.total}`")
        cents = F.when(c("p.platform") == m.platform, number.try_cast("long") if m.in_cents else dollars_to_cents(number.try_cast("double"))).otherwise(cents)
    fault = (
        F.when(F.coalesce(*fields).isNull(), "not_json")
        .when(~F.coalesce(c("p.platform").isin(*[m.platform for m in mappings]), F.lit(False)), "unknown_platform")
        .when(~placed & ~status, "unknown_event")
        .when(c("p.order_id").isNull(), "no_order_id")
        .when(F.try_to_timestamp(F.when(status, c("p.status_timestamp")).otherwise(pick("ts"))).isNull(), "bad_timestamp")
        .when(status & c("p.status").isNull(), "no_status")
        .when(placed & cents.isNull(), "bad_total")
    )
    return df.select(*bronze.columns, fault.alias("fault"))
