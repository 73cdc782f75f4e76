"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rating_0_100
from ..operators import align, bitemporal, cdc, dims, distinct, facts, health, identity, pit, quality, sensors, trips, upsert, vault
from ..session import shared_folder
from ..sources import export, feeds
from ..sources.bronze import envelope, read_seed, read_table, write_table
from ..sources.snapshots import Snapshots
from ..streaming import alarms, joins, stream
from . import incremental, marts
from .star import Star, bronze, load_ts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
    return f


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the session."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder and read from there, as a table that is asked for several times."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ORDER_COLS = ["customer_key", "order_total_cents", "order_timestamp", "kitchen_id", "brand_name", "platform", "platform_customer_id", "platform_order_id", "item_count", "raw_email", "zone_id", "ingestion_timestamp", "is_late_arriving"]


@query
def bronze_envelope(s: Star) -> DataFrame:
    return s.bronze_orders().select("kafka_topic", "kafka_offset", "kafka_timestamp", "ingestion_timestamp", "ingestion_date", "ingestion_hour")


@query
def orders_aligned(s: Star) -> DataFrame:
    return align.placed_orders(s.bronze_orders()).select(*ORDER_COLS, "kafka_offset")


@query
def orders_dedup(s: Star) -> DataFrame:
    return s.orders().select(*ORDER_COLS)


@query
def bronze_profile(s: Star) -> DataFrame:
    return health.bronze_profile(s.bronze_orders())


@query
def platform_profile(s: Star) -> DataFrame:
    return health.platform_profile(s.orders())


@query
def identity_profile(s: Star) -> DataFrame:
    return health.identity_profile(s.hub(), s.bridge())


@query
def hub_customer(s: Star) -> DataFrame:
    return s.hub()


@query
def hub_order(s: Star) -> DataFrame:
    return vault.hub_order(None, s.orders(), load_ts())


@query
def hub_insert_only_second_batch(s: Star) -> DataFrame:
    o = s.orders()
    first = vault.hub_customer(None, o.filter(F.col("order_timestamp") < "1998-01-01"), load_ts())
    return vault.hub_customer(first, o.filter(F.col("order_timestamp") >= "1998-01-01"), F.lit("2003-01-01").cast("timestamp"))


@query
def hub_kitchen(s: Star) -> DataFrame:
    return vault.hub_of(None, s.orders(), "kitchen_id", "platform", ["order_timestamp", "platform_order_id"], load_ts())


@query
def links_order(s: Star) -> DataFrame:
    o = s.orders().select(F.sha2("platform_order_id", 256).alias("order_hk"), F.col("customer_key").alias("customer_hk"))
    return vault.link(None, o, "link_hk", ["order_hk", "customer_hk"], load_ts())


@query
def sat_order_scd2_two_batches(s: Star) -> DataFrame:
    o = s.orders()
    k = F.regexp_extract("platform_order_id", "([0-9]+)$", 1).cast("long")
    change = F.when(k % 10 == 0, F.col("order_total_cents") + 100).otherwise(F.col("order_total_cents"))
    day = F.timestamp_seconds(F.unix_timestamp("ingestion_timestamp") + 86_400)
    second = o.filter(k % 10 < 2).withColumn("order_total_cents", change).withColumn("ingestion_timestamp", day)
    sat = vault.sat_order_details(vault.sat_order_details(None, o), second)
    return sat.select("order_hk", "order_total_cents", "effective_start", "effective_end", "is_current")


@query
def sat_order_status(s: Star) -> DataFrame:
    h = facts.state_intervals(s.events())
    return h.select(F.sha2("order_id", 256).alias("order_hk"), "status", "previous_status", F.col("status_timestamp").alias("effective_start"), "effective_end", "is_current")


@query
def sat_customer_profile(s: Star) -> DataFrame:
    return vault.sat_customer_profile(None, s.bridge()).drop("row_hash")


@query
def identity_bridge(s: Star) -> DataFrame:
    return s.bridge()


@query
def identity_bridge_two_batches(s: Star) -> DataFrame:
    o = s.orders()
    early, late = F.col("order_timestamp") < "1998-01-01", F.col("order_timestamp") >= "1998-01-01"
    return identity.bridge(o.filter(late), identity.bridge(o.filter(early)))


@query
def identity_confidence(s: Star) -> DataFrame:
    return identity.with_confidence(s.bridge())


@query
def identity_fuzzy(s: Star) -> DataFrame:
    people = s.table("supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("kitchen "), F.conv(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 3), 16, 10)).alias("name"))
    return identity.fuzzy(people, "s_suppkey", "name", ["s_nationkey"], 2)


@query
def dim_date(s: Star) -> DataFrame:
    """The calendar of the orders' years, with the orders of each day."""
    days = s.orders().groupBy(F.to_date("order_timestamp").alias("full_date")).agg(F.count(F.lit(1)).alias("n_orders"))
    return s.date().join(days, "full_date", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


@query
def dim_time(s: Star) -> DataFrame:
    """The minutes of a day, with the orders of each."""
    from ..functions import time_key

    used = s.orders().groupBy(time_key(F.col("order_timestamp")).alias("time_key")).agg(F.count(F.lit(1)).alias("n_orders"))
    return dims.time(s.spark).join(used, "time_key", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


@query
def dim_kitchen(s: Star) -> DataFrame:
    return s.kitchen()


@query
def dim_brand(s: Star) -> DataFrame:
    return s.brand()


@query
def dim_zone(s: Star) -> DataFrame:
    return s.zone()


@query
def dim_customer(s: Star) -> DataFrame:
    return s.customer().drop("effective_end")


@query
def dim_menu_item(s: Star) -> DataFrame:
    return dims.menu_item(s.menu()).drop("menu_item_key")


@query
def bridge_kitchen_brand(s: Star) -> DataFrame:
    return dims.pairs(s.orders(), s.kitchen(), s.brand())


@query
def fact_order(s: Star) -> DataFrame:
    return s.fact_order()


@query
def fact_order_final_state(s: Star) -> DataFrame:
    return facts.final_state(s.events())


@query
def order_state_history(s: Star) -> DataFrame:
    return facts.state_history(s.events(), s.kitchen())


@query
def menu_cdc_history(s: Star) -> DataFrame:
    return s.menu().drop("description", "is_active")


@query
def menu_current(s: Star) -> DataFrame:
    return s.menu().filter("is_current").select("brand", "item_id", "price_cents", "effective_start")


@query
def menu_price_history(s: Star) -> DataFrame:
    return marts.menu_price_history(dims.menu_item(s.menu()))


@query
def pit_menu_join(s: Star) -> DataFrame:
    sold = s.table("lineitem").groupBy("l_partkey", F.col("l_shipdate").cast("timestamp").alias("l_shipdate")).agg(F.count(F.lit(1)).alias("n"))
    sold = sold.withColumn("item_id", F.concat(F.lit("I"), F.col("l_partkey").cast("string")))
    return pit.pit_join(sold, s.menu().select("item_id", "price_cents", "effective_start", "effective_end"), ["item_id"], "l_shipdate")


@query
def sensor_clean(s: Star) -> DataFrame:
    return s.readings()


@query
def sensor_hourly(s: Star) -> DataFrame:
    return sensors.hourly(s.readings())


@query
def sensor_zone_rules(s: Star) -> DataFrame:
    r = sensors.clean(s.bronze_sensors(), sensors.zone_rule())
    return r.groupBy("sensor_type", "zone").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"))


@query
def sensor_jumps(s: Star) -> DataFrame:
    return sensors.jumps(s.readings(), 200.0).select("reading_id", "sensor_id", "value", "previous_value", F.round("drift", 4).alias("drift"))


@query
def sensor_gaps(s: Star) -> DataFrame:
    return sensors.gaps(s.readings(), 20_000).select("reading_id", "sensor_id", "previous_timestamp", "gap_seconds")


@query
def arrival_lag(s: Star) -> DataFrame:
    return sensors.arrival_lag(s.pings(), "delivery_id", "event_timestamp", "sync_timestamp")


@query
def gps_pings(s: Star) -> DataFrame:
    return s.pings().select("delivery_id", "order_id", "driver_id", "lat", "lon", "speed_mph", "event_timestamp")


@query
def delivery_trips(s: Star) -> DataFrame:
    return trips.link_orders(trips.summarise(s.pings()), s.fact_order())


@query
def trip_path_distance(s: Star) -> DataFrame:
    return trips.path_distance(s.pings())


@query
def rev_kitchen_day(s: Star) -> DataFrame:
    return marts.revenue_by_kitchen_day(s.fact_order(), s.date(), s.kitchen())


@query
def rev_brand_day(s: Star) -> DataFrame:
    return marts.revenue_by_brand_day(s.fact_order(), s.date(), s.brand())


@query
def delivery_by_zone(s: Star) -> DataFrame:
    return marts.delivery_by_zone(trips.summarise(s.pings()), s.fact_order(), s.zone())


@query
def multi_platform_customers(s: Star) -> DataFrame:
    return marts.multi_platform_customers(s.customer(), s.fact_order())


@query
def top_customers(s: Star) -> DataFrame:
    return marts.top_customers(s.customer(), s.fact_order())


@query
def sensor_anomalies(s: Star) -> DataFrame:
    return marts.sensor_anomalies(sensors.hourly(s.readings()), s.kitchen())


@query
def dq_fact_order(s: Star) -> DataFrame:
    return quality.run(s.fact_order(), "fact_order", quality.FACT_ORDER)


@query
def dq_dim_customer(s: Star) -> DataFrame:
    return quality.run(s.customer(), "dim_customer", quality.DIM_CUSTOMER)


@query
def dq_dim_menu_item(s: Star) -> DataFrame:
    return quality.run(dims.menu_item(s.menu()), "dim_menu_item", [*quality.DIM_MENU_ITEM, quality.Rule("one_current", "brand,item_id")])


@query
def dq_states(s: Star) -> DataFrame:
    return quality.run(s.events(), "states", [quality.Rule("has_state", "order_id", {"state_column": "status", "state": "placed"}), quality.Rule("columns", args={"names": ["order_id", "status"]})]).unionByName(quality.run(s.table("orders"), "orders", [quality.Rule("columns", args={"names": ["o_orderkey", "o_orderdate", "o_zone"]})]))


@query
def fk_orphans(s: Star) -> DataFrame:
    f = s.fact_order()
    return health.orphans(f, s.kitchen(), "kitchen_key", "kitchen_key").unionByName(health.orphans(f, s.brand(), "brand_key", "brand_key"))


@query
def grain_check(s: Star) -> DataFrame:
    return health.grain(s.fact_order(), ["platform_order_id"])


@query
def pii_scan(s: Star) -> DataFrame:
    return health.pii_scan({"dim_customer": s.customer(), "identity_bridge": s.bridge()})


@query
def freshness(s: Star) -> DataFrame:
    return health.freshness(s.bronze_orders(), "ingestion_timestamp", F.lit("2001-08-02 12:00:00").cast("timestamp"))


@query
def health_verdict(s: Star) -> DataFrame:
    counts = health.row_counts({"orders": s.orders(), "customer": s.table("customer")}, {"orders": 1000, "customer": 1000})
    return health.verdict(counts.select("status").unionByName(health.grain(s.orders(), ["platform_order_id"]).select("status")))


@query
def row_counts(s: Star) -> DataFrame:
    return health.row_counts({"orders": s.orders(), "customer": s.table("customer")}, {"orders": 1000, "customer": 1000})


@query
def row_counts_gold(s: Star) -> DataFrame:
    """Rows of all tables of the dimensional set against their least counts."""
    return health.row_counts(s.gold(), health.GOLD_LEAST)


@query
def bronze_samples(s: Star) -> DataFrame:
    """A whole record of every hour of ingestion, its payload parsed."""
    found = align.parse(health.bronze_samples(s.bronze_orders()))
    return found.select("ingestion_date", "ingestion_hour", "n", "kafka_offset", "p.platform", "p.order_id")


@query
def row_count_drop(s: Star) -> DataFrame:
    return health.count_drop(s.orders(), "order_timestamp")


@query
def feedback_0_100(s: Star) -> DataFrame:
    return s.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rating_0_100(F.col("l_quantity"), 0.0, 50.0).alias("rating"))


@query
def upsert_scd1(s: Star) -> DataFrame:
    base = s.table("customer").select("c_custkey", "c_acctbal", F.lit(1).alias("batch"))
    new = base.filter(F.col("c_custkey") % 3 == 0).select((F.col("c_custkey") * 2).alias("c_custkey"), "c_acctbal", F.lit(2).alias("batch"))
    return upsert.upsert(base, new, ["c_custkey"])


@query
def stream_bronze(s: Star) -> DataFrame:
    """Orders streamed into a landing table under their envelope, read back."""
    o = _stream_of(s, "orders")
    key = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    records = o.select(key.cast("string").cast("binary").alias("key"), F.to_json(F.struct("o_orderkey", "o_custkey")).cast("binary").alias("value"), F.lit("orders").alias("topic"), F.lit(0).alias("partition"), key.alias("offset"), at.alias("timestamp"), F.lit(0).alias("timestampType"))
    out = stream.run_once(s.spark, envelope(records, F.col("timestamp")), scratch(s.spark), scratch(s.spark))
    return out.groupBy("ingestion_date").agg(F.count(F.lit(1)).alias("n"), F.max("kafka_offset").alias("max_offset"))


def _stream_of(s: Star, name: str) -> DataFrame:
    """A stream over one table's files, whether the table is a file or a folder."""
    schema = s.table(name).schema
    return s.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{s.dir}/{name}.parquet*")


@query
def stream_dedup_watermark(s: Star) -> DataFrame:
    e = _stream_of(s, "events").select((F.col("event_id") - F.col("event_id") % 2).alias("pair"), F.col("ts").cast("timestamp").alias("ts"))
    out = stream.run_once(s.spark, stream.dedup(e, ["pair"], "ts").select("pair"), scratch(s.spark), scratch(s.spark))
    return out.select("pair")


@query
def stream_hourly(s: Star) -> DataFrame:
    """Hours closed by a watermark of no delay: all but the last."""
    e = _stream_of(s, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = stream.run_once(s.spark, stream.rollup(e, ["event_type"], "ts", "value", "0 seconds"), scratch(s.spark), scratch(s.spark))
    return out.select("hour", "event_type", "reading_count", "min_value", "max_value")


@query
def stream_upsert(s: Star) -> DataFrame:
    """Last value per user by foreachBatch, in hash buckets; equal to the batch answer."""
    base, last = scratch(s.spark), F.max_by(F.struct("value", "ts"), F.struct("ts", "event_id"))
    reduce = lambda b: b.groupBy("user_id").agg(last.alias("x")).select("user_id", F.col("x.value").alias("value"), F.col("x.ts").alias("ts"))
    events = _stream_of(s, "events")
    q = events.writeStream.foreachBatch(stream.bucket_upsert_sink(base, ["user_id"], reduce, buckets=16)).option("checkpointLocation", scratch(s.spark)).trigger(availableNow=True).start()
    stream.finish(q, 300)
    return Snapshots(s.spark, base).read(reduce(events).schema)


@query
def sensor_offline_alarms(s: Star) -> DataFrame:
    """An alarm for every silence of over 20 000 s, raised by timers of a stream over the readings."""
    readings = s.stream_of("silver_readings")
    out = alarms.offline_alarms(readings, "sensor_id", "event_timestamp", 20_000, "1 hour")
    return stream.run_once(s.spark, out, scratch(s.spark), scratch(s.spark))


@query
def stream_order_pickups(s: Star) -> DataFrame:
    """Orders with their courier's pickup within 40 minutes, and those without one, from two streams."""
    picked = s.stream_of("silver_states").filter("status = 'picked_up'").select(F.col("order_id").alias("platform_order_id"), F.col("status_timestamp").alias("picked_up_ts"))
    placed = s.stream_of("silver_orders").select("platform_order_id", F.col("order_timestamp").alias("placed_ts"))
    out = joins.interval_join(placed, picked, ["platform_order_id"], "placed_ts", "picked_up_ts", "0 seconds", "40 minutes", "1 hour", "1 hour")
    return stream.run_once(s.spark, out, scratch(s.spark), scratch(s.spark))


@query
def backfill_range(s: Star) -> DataFrame:
    return stream.backfill(s.bronze_orders(), "1996-01-01", "1996-12-31", align.align).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.sum("order_total_cents").alias("cents"))


@query
def reconcile_48h(s: Star) -> DataFrame:
    return stream.reconcile(s.bronze_orders(), "1999-06-01 12:00:00", 48, align.align).select("platform_order_id", "order_total_cents", "order_timestamp")


@query
def jdbc_roundtrip(s: Star) -> DataFrame:
    """Daily order counts written to the bundled in-memory database and read back."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    daily = s.orders().groupBy(F.to_date("order_timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))
    done = export.export_tables(s.spark, {"DAILY_ORDERS": daily}, url, props, partitions=1).first()
    if not done["success"]:
        raise RuntimeError(done["error"])
    back = s.spark.read.jdbc(url, "DAILY_ORDERS", properties=props)
    return back.toDF(*[c.lower() for c in back.columns])


@query
def menu_cdc_two_batches(s: Star) -> DataFrame:
    """The history after a second batch of changes, which holds one of the first batch again."""
    log, cut = s.bronze_menu(), F.lit("1998-01-01").cast("timestamp")
    first = cdc.menu_history(log.filter(F.col("kafka_timestamp") < cut))
    second = log.filter((F.col("kafka_timestamp") >= cut) | (F.col("kafka_timestamp") < "1995-01-02"))
    return cdc.menu_history(second, first).drop("description", "is_active")


@query
def sat_order_late_changes(s: Star) -> DataFrame:
    o = s.orders()
    k = F.regexp_extract("platform_order_id", "([0-9]+)$", 1).cast("long")
    day = F.timestamp_seconds(F.unix_timestamp("ingestion_timestamp") - F.when(k % 20 == 0, 86_400).otherwise(-86_400))
    late = o.filter(k % 10 == 0).withColumn("order_total_cents", F.col("order_total_cents") + 100).withColumn("ingestion_timestamp", day)
    late = late.unionByName(o.filter(k % 10 == 1)).withColumn("order_hk", F.sha2("platform_order_id", 256))
    found = upsert.late_changes(vault.sat_order_details(None, o), late, ["order_hk"], vault.ORDER_TRACKED, "ingestion_timestamp")
    return found.select("order_hk", "order_total_cents", "ingestion_timestamp")


@query
def sat_order_bitemporal(s: Star) -> DataFrame:
    """Order totals as they were known after each of three batches, two of them with changes that came late."""
    o = s.orders().select("platform_order_id", "order_total_cents", F.col("ingestion_timestamp").alias("ts"), F.regexp_extract("platform_order_id", "([0-9]+)$", 1).cast("long").alias("k"))
    later = lambda days: F.timestamp_seconds(F.unix_timestamp("ts") + days * 86_400)
    more = lambda cents: F.col("order_total_cents") + cents
    late = o.filter("k % 10 = 0").withColumns({"ts": later(-1), "order_total_cents": more(100)})
    batches = [o, late.unionByName(o.filter("k % 10 = 1").withColumns({"ts": later(1), "order_total_cents": more(50)})), o.filter("k % 20 < 2").withColumn("ts", later(2))]
    table, out = None, None
    for n, batch in enumerate(batches, 1):
        table = stored(bitemporal.apply_batch(table, batch.drop("k"), ["platform_order_id"], ["order_total_cents"], "ts", F.lit(f"2003-01-0{n} 00:00:00")).drop("row_hash"))
    for n in (1, 2, 3):
        rows = bitemporal.known_at(table, F.lit(f"2003-01-0{n} 12:00:00").cast("timestamp"))
        seen = bitemporal.versions(rows, ["platform_order_id"], ["order_total_cents"]).withColumn("batch", F.lit(n))
        out = seen if out is None else out.unionByName(seen)
    # the hash of an order's name is made last: the name is shorter, and it is what rows meet by
    return out.select(F.sha2("platform_order_id", 256).alias("order_hk"), *out.columns[1:])


@query
def fact_order_default_zone(s: Star) -> DataFrame:
    """Every seventh order comes without a zone and gets its kitchen's default one."""
    k = F.regexp_extract("platform_order_id", "([0-9]+)$", 1).cast("long")
    o = s.orders().withColumn("zone_id", F.when(k % 7 != 0, F.col("zone_id")))
    f = facts.orders(facts.default_zone(o, s.kitchen(), s.zone()), s.kitchen(), s.brand(), s.zone())
    return f.select("platform_order_id", "zone_key")


@query
def fact_sensor_hourly(s: Star) -> DataFrame:
    return sensors.fact_hourly(s.readings(), s.kitchen())


@query
def seed_last_wins(s: Star) -> DataFrame:
    """Two loads of one seed: the later one counts."""
    base = s.table("supplier").select(F.concat(F.lit("K-"), F.col("s_suppkey").cast("string")).alias("kitchen_id"), F.col("s_name").alias("name"), F.lit(1).alias("load"))
    again = base.filter(F.length("kitchen_id") % 2 == 0).withColumn("name", F.upper("name")).withColumn("load", F.lit(2))
    return dims.from_seed(base.unionByName(again), "kitchen_id", "kitchen_key", "load")


@query
def seed_csv(s: Star) -> DataFrame:
    """Kitchens as a seed file with upper-case headers, read under a schema."""
    path = scratch(s.spark)
    k = feeds.kitchens(s.spark, s.dir)
    k.select(*[F.col(c).alias(c.upper()) for c in k.columns]).write.csv(path, header=True)
    return dims.from_seed(read_seed(s.spark, path, ", ".join(f"{c.upper()} {t}" for c, t in k.dtypes)), "kitchen_id", "kitchen_key")


@query
def schema_merge(s: Star) -> DataFrame:
    """A table overwritten with a new schema, then appended to with one more column, read with all of them."""
    path = scratch(s.spark)
    c = s.table("customer")
    write_table(c.select(F.col("c_custkey").cast("string").alias("old")), path)
    write_table(c.filter("c_custkey % 2 = 0").select("c_custkey", "c_acctbal"), path)
    write_table(c.filter("c_custkey % 2 = 1").select("c_custkey", "c_acctbal", "c_mktsegment"), path, "append")
    return read_table(s.spark, path, mergeSchema="true").select("c_custkey", "c_acctbal", "c_mktsegment")


@query
def hub_menu_item(s: Star) -> DataFrame:
    rows = s.menu().withColumn("source", F.lit("menu"))
    return vault.hub_of(None, rows, "item_id", "source", ["effective_start"], load_ts())


@query
def link_order_kitchen_brand(s: Star) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c), 256)
    o = s.orders().select(sha("platform_order_id").alias("order_hk"), sha("kitchen_id").alias("kitchen_hk"), sha("brand_name").alias("brand_hk"))
    return vault.link(None, o, "link_hk", ["order_hk", "kitchen_hk", "brand_hk"], load_ts())


@query
def identity_fuzzy_address(s: Star) -> DataFrame:
    """Customers of one segment whose addresses are near each other."""
    people = s.table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.concat_ws(" ", F.lit("house"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 4)).alias("address"))
    return identity.fuzzy(people, "c_custkey", "address", ["segment"], 1)


@query
def bronze_totals(s: Star) -> DataFrame:
    return health.bronze_totals(s.bronze_orders())


@query
def dq_more(s: Star) -> DataFrame:
    r = s.readings()
    rules = [quality.Rule("rate_between", "is_anomaly", {"flag": F.col("is_anomaly"), "min": 0.0, "max": 0.25}), quality.Rule("drift_below", "value", {"by": "sensor_id", "order": ["event_timestamp", "reading_id"], "limit": 200})]
    zone = quality.run(s.zone(), "dim_zone", [quality.Rule("row_count", args={"n": 125})])
    time = quality.run(dims.time(s.spark), "dim_time", [quality.Rule("row_count", args={"n": 1440})])
    return quality.run(r, "sensors", rules).unionByName(zone).unionByName(time)


@query
def dq_pass_rate(s: Star) -> DataFrame:
    checks = quality.run(s.fact_order(), "fact_order", quality.FACT_ORDER).unionByName(quality.run(s.customer(), "dim_customer", quality.DIM_CUSTOMER))
    return health.pass_rate(checks)


@query
def replace_partitions(s: Star) -> DataFrame:
    """Orders per year and platform; then one year is replaced and the others stay."""
    path = scratch(s.spark)
    g = s.orders().groupBy(F.year("order_timestamp").alias("year"), "platform").agg(F.sum("order_total_cents").alias("cents"))
    stream.replace_partitions(g, path, "year")
    stream.replace_partitions(g.filter("year = 1997").withColumn("cents", -F.col("cents")), path, "year")
    return s.spark.read.parquet(path).select("year", "platform", "cents")


@query
def stream_sliding(s: Star) -> DataFrame:
    """Hours that start every half hour, closed by a watermark of no delay."""
    e = _stream_of(s, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = stream.run_once(s.spark, stream.rollup(e, ["event_type"], "ts", "value", "0 seconds", slide="30 minutes"), scratch(s.spark), scratch(s.spark))
    return out.select("hour", "event_type", "reading_count", "min_value", "max_value")


@query
def jdbc_gold_tables(s: Star) -> DataFrame:
    """The dimensional set exported in order (dimensions first), and the rows that arrived."""
    url, props = export.connection({"EXPORT_JDBC_URL": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "EXPORT_JDBC_DRIVER": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    for r in export.export_tables(s.spark, s.gold(), url, props, partitions=2).collect():
        if not r["success"]:
            raise RuntimeError(f"{r['table_name']}: {r['error']}")
    out = None
    for name in s.gold():
        one = s.spark.read.jdbc(url, name, properties=props).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _damaged(s: Star) -> DataFrame:
    """The landed orders, some of them broken on the way."""
    k, raw = F.floor(F.col("kafka_offset") / 10), F.col("raw_value")
    broken = F.when(k % 101 == 0, F.substring(raw, 1, 20)).when(k % 103 == 0, F.replace(raw, F.lit('"platform":"'), F.lit('"platform":"x_')))
    broken = broken.when(k % 107 == 0, F.replace(raw, F.lit('"order_id"'), F.lit('"order"'))).when(k % 109 == 0, F.regexp_replace(raw, '"(order_timestamp|created_at|timestamp)":"', '"$1":"on '))
    broken = broken.when(k % 113 == 0, F.regexp_replace(raw, '"(total_amount|order_value|amount_cents)":', '"$1":"?","was":'))
    return s.bronze_orders().withColumn("raw_value", broken.otherwise(raw))


@query
def orders_quarantine(s: Star) -> DataFrame:
    """Broken records and why they go to the quarantine table; the good ones go on."""
    path = scratch(s.spark)
    align.faults(_damaged(s)).filter("fault is not null").write.partitionBy("fault").parquet(path)
    return s.spark.read.parquet(path).select("kafka_offset", "fault")


@query
def dq_observed_write(s: Star) -> DataFrame:
    """The row rules of the order fact, counted while it is written."""
    rows = [r for r in quality.FACT_ORDER if r.kind != "unique"]
    path = scratch(s.spark)
    return quality.observed_write(s.fact_order(), lambda df: df.write.parquet(path), "fact_order", rows)


@query
def nightly_reconciliation(s: Star) -> DataFrame:
    """Monthly revenue by platform that missed late orders; the months of the last 48 hours are made anew."""
    table = Snapshots(s.spark, scratch(s.spark))

    def build(bronze: DataFrame) -> DataFrame:
        orders = align.placed_orders(bronze).select(F.date_format("ingestion_timestamp", "yyyy-MM").alias("ingestion_month"), "platform", "order_total_cents", "is_late_arriving")
        return orders.groupBy("ingestion_month", "platform").agg(F.count(F.lit(1)).alias("n"), F.sum("order_total_cents").alias("cents"))

    in_time = F.unix_timestamp("ingestion_timestamp") - F.unix_timestamp("kafka_timestamp") <= 86_400
    table.replace(build(s.bronze_orders().filter(in_time)), "ingestion_month")
    stream.reconcile_into(table, s.bronze_orders(), "1999-06-01 12:00:00", 48, build, "ingestion_month", 7)
    return table.read("platform string, n long, cents long", "ingestion_month")


@query
def identity_people(s: Star) -> DataFrame:
    """Customers with their identity: by email, else by near addresses in a segment; some set by hand."""
    k = F.col("c_custkey")
    mail = F.when(k % 3 != 0, F.concat(F.lit("mail"), F.floor(k / 2).cast("long").cast("string"), F.lit("@x.org")))
    people = s.table("customer").select("c_custkey", mail.alias("email"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("house "), F.substring(F.md5(k.cast("string")), 1, 3)).alias("address"))
    by_hand = people.filter("c_custkey % 50 = 7").select("c_custkey", F.concat(F.lit("by hand "), k.cast("string")).alias("identity_key"))
    return identity.identities(people, "c_custkey", "email", "address", ["segment"], 1, overrides=by_hand)


@query
def rev_kitchen_day_incremental(s: Star) -> DataFrame:
    """The view after three batches, the last of corrections: no order is read that did not change."""
    now = s.fact_order()
    k = F.regexp_extract("platform_order_id", "([0-9]+)$", 1).cast("long")
    wrong = (k % 7 == 0) | F.col("is_cancelled")
    first = now.withColumns({"order_total_cents": F.when(k % 7 == 0, F.col("order_total_cents") + 500).otherwise(F.col("order_total_cents")), "kitchen_key": F.when(k % 21 == 0, F.lit(-1).cast("long")).otherwise(F.col("kitchen_key"))})
    first = first.withColumns({"changed": wrong, "is_cancelled": F.lit(False)})
    early = F.col("order_placed_ts") < "1998-01-01"
    keys, stored = incremental.KITCHEN_DAY, None
    for batch in (first.filter(early), first.filter(~early)):
        stored = incremental.merge(stored, incremental.deltas(None, batch.drop("changed"), keys), keys)
    stored = incremental.merge(stored, incremental.deltas(first.filter("changed").drop("changed"), now.filter(wrong), keys), keys)
    return incremental.kitchen_day_view(stored, s.date(), s.kitchen())


@query
def rev_brand_day_incremental(s: Star) -> DataFrame:
    """Revenue by brand with distinct customers, after orders that changed their customer."""
    now = s.fact_order()
    moved = F.regexp_extract("platform_order_id", "([0-9]+)$", 1).cast("long") % 9 == 0
    first = now.withColumn("customer_hk", F.when(moved, F.sha2("platform_order_id", 256)).otherwise(F.col("customer_hk")))
    keys = [*incremental.BRAND_DAY, "customer_hk"]
    stored = incremental.merge(None, incremental.deltas(None, first, keys), keys)
    stored = incremental.merge(stored, incremental.deltas(first.filter(moved), now.filter(moved), keys), keys)
    return incremental.brand_day_view(stored, s.date(), s.brand())


@query
def unique_customers_rollup(s: Star) -> DataFrame:
    """Distinct customers by platform and day, week and month, all from the bitmaps of the days."""
    o = s.orders().select(F.to_date("order_timestamp").alias("day"), "platform", "customer_key")
    early = F.col("day") < "1998-01-01"
    ids = distinct.dense_ids(o.filter(~early), "customer_key", stored(distinct.dense_ids(o.filter(early), "customer_key")))
    path = scratch(s.spark)
    distinct.bitmaps(o, ["day", "platform"], ids, "customer_key").write.parquet(path)
    days, out = s.spark.read.parquet(path), None
    for name, key in (("day", F.col("day")), ("week", F.trunc("day", "week")), ("month", F.trunc("day", "month"))):
        keyed = days.withColumn("start", key)
        one = distinct.counts(keyed if name == "day" else distinct.merged(keyed, ["start", "platform"]), ["start", "platform"], "customers").select(F.lit(name).alias("period"), "start", "platform", "customers")
        out = one if out is None else out.unionByName(one)
    return out


__all__ = ["QUERIES", "bronze", "feeds"]
