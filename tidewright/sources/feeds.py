"""Raw event feeds derived from the star-schema tables.

Orders, line items, events and parts become the JSON records that the platforms, sensors,
couriers and menu database would send: three order shapes, duplicates, late arrivals, missing
emails, deletes. Only integer arithmetic on keys, so the same rows can be derived in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

STATUSES = ("confirmed", "preparing", "ready", "picked_up", "delivered")
ZONE_KINDS = ("DOWNTOWN", "MIDTOWN", "UPTOWN", "SUBURBS-N", "SUBURBS-S")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _plus(ts: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(ts) + seconds)


def _record(df: DataFrame, topic: str, key: Column, payload: Column, offset: Column, event_ts: Column, ingested: Column, *more: str) -> DataFrame:
    return df.select(
        key.cast("string").cast("binary").alias("key"),
        payload.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.pmod(F.hash(key.cast("string")), F.lit(4)).cast("int").alias("partition"),
        offset.cast("long").alias("offset"),
        event_ts.alias("timestamp"),
        F.lit(0).alias("timestampType"),
        ingested.alias("ingested_at"),
        *more,
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").repartition("o_orderkey"))


def _placed(o: DataFrame) -> Column:
    return _plus(o["o_orderdate"], (o["o_orderkey"] % 1440) * 60)


def _ingested(o: DataFrame) -> Column:
    """When an order with its ``copy`` arrives."""
    delay = F.when(o["o_orderkey"] % 33 == 0, F.lit(108_000)).otherwise(F.lit(60))
    return _plus(_placed(o), delay + o["copy"] * 300)


def _shaped(o: DataFrame, *more: str | Column) -> DataFrame:
    """The fields of orders that every platform sends, from their keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("k"),
        _pick(k % 3, ("uber_eats", "doordash", "own_app")).alias("platform"),
        F.concat(_pick(k % 3, ("UE-", "DD-", "OA-")), k.cast("string")).alias("order_id"),
        F.concat(F.lit("C"), c.cast("string")).alias("customer"),
        F.when(k % 50 != 0, F.concat(F.lit(" User"), c.cast("string"), F.lit("@Example.com"))).alias("email"),
        F.col("o_totalprice").alias("total"),
        F.concat(F.lit("K-"), (c % 101).cast("string")).alias("kitchen_id"),
        F.concat(F.lit("Brand#"), (k % 26 + 1).cast("string")).alias("brand"),
        F.concat(F.lit("NATION_"), (c % 25).cast("string"), F.lit("-"), _pick(k % 5, ZONE_KINDS)).alias("zone"),
        _placed(o).alias("ts"),
        *([_ingested(o).alias("ingested")] if "copy" in o.columns else []),
        *more,
    )


def order_records(spark: SparkSession, sf_dir: str, with_items: bool = True, by_day: bool = False) -> DataFrame:
    """Placed orders in their platform's shape; every twentieth is sent twice.

    ``by_day``: with a column ingestion_date, by which rows are dealt and sorted, so that a table in days
    is written without another sort. Keys and numbers alone are shuffled and sorted; texts and payloads
    are made of them after the last shuffle.
    """
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").repartition("o_orderkey")
    if with_items:
        # dealt before they are gathered: an order's items are few, so lists of parts of them save nothing
        sold = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").alias("price")).repartition("l_orderkey")
        items = sold.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_partkey", "qty", "price")).alias("sold"))
        o = o.join(items, "o_orderkey", "left")
    copies = F.when(F.col("o_orderkey") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    o = o.withColumn("copy", F.explode(copies))
    if by_day:
        o = o.withColumn("ingestion_date", F.date_format(_ingested(o), "yyyy-MM-dd"))
        # a file a day and task at most, whatever the task that made the rows; large days are split
        o = o.hint("rebalance", "ingestion_date").sortWithinPartitions("ingestion_date")
    more = ["copy", *(["ingestion_date"] if by_day else [])]
    if with_items:
        item = lambda x: F.struct(F.concat(F.lit("I"), x["l_partkey"].cast("string")).alias("item_id"), x["qty"].alias("qty"), x["price"].alias("price"))
        o = _shaped(o, *more, F.array_sort(F.transform("sold", item)).alias("items"))
    else:
        o = _shaped(o, *more, F.lit(None).cast("array<struct<item_id:string,qty:int,price:double>>").alias("items"))
    c = F.col
    common = [c("order_id"), c("platform")]
    uber = F.to_json(F.struct(*common, c("kitchen_id"), c("brand").alias("brand_name"), c("customer").alias("customer_uid"), c("email").alias("customer_email"), c("items"), c("total").alias("total_amount"), F.lit("USD").alias("currency"), F.lit("placed").alias("order_status"), _iso(c("ts")).alias("order_timestamp"), c("zone").alias("delivery_zone")))
    door = F.to_json(F.struct(*common, c("kitchen_id").alias("store_id"), c("brand").alias("store_name"), c("customer").alias("dasher_customer_id"), c("email").alias("customer_email"), c("items").alias("line_items"), c("total").alias("order_value"), F.lit("placed").alias("order_status"), _iso(c("ts")).alias("created_at"), c("zone").alias("drop_off_zone")))
    own = F.to_json(F.struct(*common, c("kitchen_id"), c("brand"), c("customer").alias("user_id"), c("email"), c("items"), F.round(c("total") * 100).cast("long").alias("amount_cents"), F.lit("placed").alias("status"), _iso(c("ts")).alias("timestamp"), c("zone")))
    o = o.withColumn("payload", F.when(c("platform") == "uber_eats", uber).when(c("platform") == "doordash", door).otherwise(own))
    return _record(o, "orders", c("kitchen_id"), c("payload"), c("k") * 10 + c("copy"), c("ts"), c("ingested"), *more[1:])


def status_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of every order; cancelled after confirmation where k % 20 = 7."""
    o = _orders(spark, sf_dir)
    k = F.col("k")
    minutes, steps = F.lit(0).cast("long"), []
    for n, status in enumerate(STATUSES, 1):
        minutes = minutes + 2 + (k * n) % 14
        name = F.when((k % 20 == 7) & F.lit(n == 2), "cancelled").otherwise(status)
        steps.append(F.struct(name.alias("status"), (minutes * 60).alias("after"), F.lit(n).alias("n")))
    changes = F.when(k % 20 == 7, F.array(*steps[:2])).otherwise(F.array(*steps))
    s = o.select("k", "order_id", "platform", "kitchen_id", "ts", F.explode(changes).alias("s")).withColumn("at", _plus(F.col("ts"), F.col("s.after")))
    payload = F.to_json(F.struct("order_id", "platform", "kitchen_id", F.col("s.status").alias("status"), _iso(F.col("at")).alias("status_timestamp"), F.lit("status_change").alias("event_type"), F.when(F.col("s.status") == "cancelled", _pick(k % 3, ("customer", "kitchen", "courier"))).alias("reason")))
    return _record(s, "orders", F.col("kitchen_id"), payload, k * 10 + 1 + F.col("s.n"), F.col("at"), _plus(F.col("at"), F.lit(30)))


def sensor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: every hundredth without a value, every thirty-third sent twice."""
    e, c = load(spark, sf_dir, "events").repartition("event_id"), F.col
    kind = F.when(c("event_type") == "error", "humidity").when(c("event_type") == "purchase", "fryer_timer").when(c("event_type") == "click", "cooler_door").otherwise("temperature")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumn("copy", F.explode(F.when(c("event_id") % 33 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    payload = F.to_json(F.struct(
        F.concat(F.lit("R-"), c("event_id").cast("string")).alias("reading_id"),
        F.concat(F.lit("S-"), c("user_id").cast("string")).alias("sensor_id"),
        F.concat(F.lit("K-"), (c("user_id") % 101).cast("string")).alias("kitchen_id"),
        kind.alias("sensor_type"),
        F.when(c("event_id") % 100 != 0, c("value") * 2).alias("value"),
        F.lit("unit").alias("unit"),
        _pick(k % 4, ("fryer", "grill", "cooler", "ambient")).alias("zone"),
        _iso(c("ts")).alias("event_timestamp"),
    ))
    return _record(e, "sensors", c("user_id"), payload, c("event_id") * 2 + c("copy"), c("ts"), _plus(c("ts"), F.lit(10) + c("copy") * 120))


def gps_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courier positions: one delivery per user and day, every fiftieth ping sent twice."""
    e, c = load(spark, sf_dir, "events").repartition("event_id"), F.col
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumn("copy", F.explode(F.when(c("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    payload = F.to_json(F.struct(
        F.concat(F.lit("D-"), c("user_id").cast("string"), F.lit("-"), F.dayofmonth("ts").cast("string")).alias("delivery_id"),
        F.concat(F.lit("UE-"), (c("user_id") * 3).cast("string")).alias("order_id"),
        F.concat(F.lit("DR-"), (c("user_id") % 40).cast("string")).alias("driver_id"),
        (F.lit(29.0) + k / 1000).alias("lat"),
        (F.lit(-95.0) + c("value") / 10000).alias("lon"),
        (c("value") / 10).alias("speed_mph"),
        _iso(c("ts")).alias("event_timestamp"),
        _iso(_plus(c("ts"), c("event_id") % 90)).alias("sync_timestamp"),
    ))
    return _record(e, "gps", c("user_id"), payload, c("event_id") * 2 + c("copy"), c("ts"), _plus(c("ts"), F.lit(5)))


def menu_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of menu items: a create per part, a price update per line item, then deletes
    (l_partkey % 97 = 0) and re-creates (% 194 = 0)."""
    c = F.col
    first = F.timestamp_seconds(F.lit(788_918_400))  # 1995-01-01
    creates = load(spark, sf_dir, "part").select(c("p_partkey").alias("p"), "p_brand", "p_name", "p_type", F.lit("c").alias("op"), first.alias("ts"), c("p_retailprice").alias("price"), F.lit(0).cast("long").alias("seq"))
    li = load(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    last = F.lead(F.lit(True)).over(order).isNull()
    seq = F.row_number().over(order).cast("long")
    u = li.select(c("l_partkey").alias("p"), c("l_shipdate").alias("ts"), (F.floor(F.round(c("l_extendedprice") * 100) / c("l_quantity")) / 100).alias("price"), seq.alias("seq"), last.alias("last"))
    part = creates.select("p", "p_brand", "p_name", "p_type")
    # a part joins its line items where the window left them; the re-creation comes with the delete, so that line items are read once
    change = lambda ts, more, op: F.struct(ts.alias("ts"), (c("seq") + more).alias("seq"), op.alias("op"))
    now = change(c("ts"), 0, F.when(c("last") & (c("p") % 97 == 0), "d").otherwise("u"))
    both = F.array(now, change(_plus(c("ts"), F.lit(86_400)), 1, F.lit("c")))
    u = u.join(part, "p").select("p", "p_brand", "p_name", "p_type", "price", F.explode(F.when(c("last") & (c("p") % 194 == 0), both).otherwise(F.array(now))).alias("e"))
    changes = creates.unionByName(u.select("p", "p_brand", "p_name", "p_type", "price", "e.ts", "e.seq", "e.op"))
    item = F.struct(F.concat(F.lit("I"), c("p").cast("string")).alias("item_id"), c("p_brand").alias("brand"), c("p_name").alias("name"), c("price"), c("p_type").alias("category"), F.lit("").alias("description"), F.lit(True).alias("active"))
    ms = F.unix_timestamp("ts") * 1000
    payload = F.to_json(F.struct("op", F.when(c("op") != "c", item).alias("before"), F.when(c("op") != "d", item).alias("after"), F.struct(F.lit("menu").alias("table"), ms.alias("ts_ms")).alias("source"), ms.alias("ts_ms")))
    return _record(changes, "menu", c("p"), payload, c("seq"), c("ts"), _plus(c("ts"), F.lit(1)))


def kitchens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.concat(F.lit("K-"), F.col("s_suppkey").cast("string")).alias("kitchen_id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("state"), (F.col("s_suppkey") % 60 + 20).cast("int").alias("capacity_orders_per_hour"), (F.col("s_acctbal") >= 0).alias("is_active"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand_name")).agg(F.min("p_type").alias("cuisine_type")).select(F.regexp_replace("brand_name", "Brand#", "BR-").alias("brand_id"), "brand_name", "cuisine_type", F.lit(True).alias("is_active"))
