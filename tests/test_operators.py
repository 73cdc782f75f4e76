"""Reference operators on small hand-made frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewright import functions as fn
from tidewright.operators import align, cdc, dims, facts, health, identity, pit, quality, sensors, trips, upsert, vault
from tidewright.operators.dedup import dedup_first
from tidewright.plans import marts
from tidewright.sources import bronze, export
from tidewright.streaming import stream

T0 = dt.datetime(2024, 5, 1, 12, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def landed(spark, records):
    rows = [(r if isinstance(r, str) else json.dumps(r), "t", 0, i, T0, at(m)) for i, (r, m) in enumerate(records)]
    return spark.createDataFrame(rows, "raw_value string, kafka_topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, ingestion_timestamp timestamp")


def uber(order_id, **more):
    base = {"order_id": order_id, "platform": "uber_eats", "kitchen_id": "K-1", "brand_name": "B", "customer_uid": "u1", "customer_email": " A@B.c ", "items": [{"item_id": "i", "qty": 1}], "total_amount": 12.34, "order_timestamp": "2024-05-01T12:00:00Z", "delivery_zone": "Z"}
    return base | more


def test_align_shapes_bad_values_and_duplicates(spark):
    b = landed(spark, [
        (uber("1"), 0), (uber("1"), 5), (uber("2", customer_email=None, total_amount="much"), 60 * 24), (uber("3", order_timestamp="soon"), 0),
        (uber("5", items=[]), 60 * 24 + 1), ("{broken", 0), ({"order_id": "1", "platform": "uber_eats", "status": "ready", "event_type": "status_change", "status_timestamp": "2024-05-01T12:09:00Z", "kitchen_id": "K-1"}, 9),
        ({"order_id": "4", "platform": "own_app", "kitchen_id": "K-2", "brand": "B2", "user_id": "u9", "amount_cents": 250, "status": "placed", "timestamp": "2024-05-01T12:00:00Z"}, 1),
        ({"order_id": "6", "platform": "doordash", "store_id": "K-3", "store_name": "B3", "dasher_customer_id": "d", "order_value": 1.005, "created_at": "2024-05-01T12:00:00Z"}, 1),
    ])
    got = {r.platform_order_id: r for r in align.align(b).collect()}
    assert set(got) == {"uber_eats_1", "uber_eats_2", "uber_eats_3", "uber_eats_5", "own_app_4", "doordash_6"}
    assert got["uber_eats_1"].ingestion_timestamp == T0 and got["uber_eats_1"].raw_email == "a@b.c" and got["uber_eats_1"].order_total_cents == 1234
    assert got["uber_eats_2"].order_total_cents is None and got["uber_eats_2"].customer_key != got["uber_eats_1"].customer_key
    assert not got["uber_eats_2"].is_late_arriving and got["uber_eats_5"].is_late_arriving and got["uber_eats_5"].item_count == 0
    assert got["uber_eats_3"].order_timestamp is None and got["own_app_4"].order_total_cents == 250 and got["doordash_6"].kitchen_id == "K-3"
    ev = {(r.order_id, r.status) for r in align.status_events(b).collect()}
    assert ("uber_eats_1", "ready") in ev and ("uber_eats_1", "placed") in ev and ("uber_eats_3", "placed") not in ev


def test_dedup_first_is_total_with_nulls_last(spark):
    df = spark.createDataFrame([(1, None, "n"), (1, 2, "b"), (1, 2, "a"), (2, None, "x")], "k int, t int, v string")
    assert {(r.k, r.v) for r in dedup_first(df, ["k"], ["t", "v"]).collect()} == {(1, "a"), (2, "x")}


def test_scd2_returns_to_an_old_value(spark):
    row = lambda k, v, m: (k, v, at(m))
    df = lambda rows: spark.createDataFrame(rows, "k string, v string, ts timestamp")
    one = upsert.scd2_apply(None, df([row("a", "A", 0), row("a", "A", 1), row("b", None, 0), row(None, "x", 0)]), ["k"], ["v"], "ts")
    two = upsert.scd2_apply(one, df([row("a", "B", 10), row("a", "A", 20), row("a", "old", -5)]), ["k"], ["v"], "ts")
    key = lambda r: (r.k, r.v, r.effective_start, r.effective_end, r.is_current)
    assert sorted(map(key, two.filter("k = 'a'").collect()), key=lambda x: x[2]) == [("a", "A", at(0), at(10), False), ("a", "B", at(10), at(20), False), ("a", "A", at(20), None, True)]
    again = upsert.scd2_apply(two, df([row("a", "B", 10), row("a", "A", 20)]), ["k"], ["v"], "ts")
    assert sorted(map(repr, map(key, again.collect()))) == sorted(map(repr, map(key, two.collect())))
    assert fn.change_hash is not None and two.filter("is_current").groupBy("k").count().filter("count > 1").count() == 0


def test_null_keeps_its_place_in_a_change_hash(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert df.select(fn.change_hash(F.col("x"), F.col("y"))).distinct().count() == 2


def test_upsert_and_insert_only(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    s = spark.createDataFrame([(2, "c", 5), (3, "d", 5)], t.schema)
    assert sorted(map(tuple, upsert.insert_only(t, s, ["k"]).collect())) == [(1, "a", 1), (2, "b", 1), (3, "d", 5)]
    assert sorted(map(tuple, upsert.upsert(t, s, ["k"]).collect())) == [(1, "a", 1), (2, "c", 5), (3, "d", 5)]
    assert sorted(map(tuple, upsert.upsert(t, s, ["k"], {"n": F.greatest("t.n", "s.n")}).collect())) == [(1, "a", 1), (2, "b", 5), (3, "d", 5)]
    assert upsert.upsert(None, s, ["k"]).count() == 2


def test_cdc_history_deletes_recreates_and_ties(spark):
    def change(op, price, ms):
        item = {"item_id": "i", "brand": "B", "name": "n", "price": price, "active": True}
        return ({"op": op, "before": item if op != "c" else None, "after": item if op != "d" else None, "ts_ms": ms}, 0)

    b = landed(spark, [change("c", 1.0, 1000), change("u", 2.0, 2000), change("u", 3.0, 2000), change("d", 3.0, 3000), change("c", 4.0, 4000), ("{", 0)])
    h = [(r.price_cents, r.is_current) for r in cdc.menu_history(b).orderBy("effective_start").collect()]
    assert h == [(100, False), (300, False), (400, True)]
    only_update = cdc.menu_history(landed(spark, [change("u", 2.0, 10)]))
    assert [(r.price_cents, r.is_current) for r in only_update.collect()] == [(200, True)]


def test_vault_and_identity(spark):
    o = spark.createDataFrame([("h1", "uber_eats", "u", "a@b.c", "o1", at(5)), ("h1", "doordash", "d", "a@b.c", "o2", at(1)), (None, "own_app", None, None, "o3", at(0))], "customer_key string, platform string, platform_customer_id string, raw_email string, platform_order_id string, order_timestamp timestamp")
    ts = F.lit("2024-01-01").cast("timestamp")
    hub = vault.hub_customer(None, o, ts)
    assert [(r.customer_hk, r.record_source) for r in hub.collect()] == [("h1", "doordash")]
    assert vault.hub_customer(hub, o, ts).count() == 1 and vault.hub_order(None, o, ts).count() == 3
    b = identity.bridge(o)
    assert {(r.platform, r.match_method) for r in b.collect()} == {("uber_eats", "exact_email"), ("doordash", "exact_email")}
    late = identity.bridge(o.withColumn("order_timestamp", F.lit("2025-01-01").cast("timestamp")), b)
    assert {(r.first_seen.year, r.last_seen.year) for r in late.collect()} == {(2024, 2025)}
    c = dims.customer(hub, b, o).first()
    assert c.platform_count == 2 and c.is_multi_platform and "@" not in c.email_masked and c.platforms_list == '["doordash","uber_eats"]'
    assert json.loads(vault.sat_customer_profile(None, b).first().platform_ids) == {"uber_eats": "u", "doordash": "d"}


def test_fuzzy_finds_all_near_names(spark):
    names = ["maria", "marie", "mari", "amaria", "john", "jon", "x", "xy", "abcdefgh", "abXdeYgh", "bcdefgh", "", None]
    df = spark.createDataFrame([(i, "z", n) for i, n in enumerate(names)], "id int, zone string, name string")

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    low = [(i, n.lower()) for i, n in enumerate(names) if n]
    want = {(i, j) for i, a in low for j, b in low if i < j and lev(a, b) <= 2 and min(len(a), len(b)) >= 3}
    got = {(r.a, r.b) for r in identity.fuzzy(df, "id", "name", ["zone"], 2).collect()}
    assert want <= got and all(lev(names[a].lower(), names[b].lower()) <= 2 for a, b in got)


def test_pit_join_boundaries(spark):
    dim = spark.createDataFrame([("a", 1, at(0), at(10)), ("a", 2, at(10), None)], "k string, v int, effective_start timestamp, effective_end timestamp")
    f = spark.createDataFrame([("a", at(-1)), ("a", at(0)), ("a", at(10)), ("b", at(5))], "k string, ts timestamp")
    assert {(r.k, r.ts, r.v) for r in pit.pit_join(f, dim, ["k"], "ts").collect()} == {("a", at(-1), None), ("a", at(0), 1), ("a", at(10), 2), ("b", at(5), None)}


def test_sensors(spark):
    def reading(i, kind, value, ts="2024-05-01T12:00:00Z", zone="fryer"):
        return {"reading_id": i, "sensor_id": "s", "kitchen_id": "k", "sensor_type": kind, "value": value, "zone": zone, "event_timestamp": ts}

    b = landed(spark, [(reading("1", "temperature", 400.0), 0), (reading("2", "temperature", 400.1), 0), (reading("2", "temperature", 1.0), 9), (reading("3", "humidity", None), 0), (reading("4", "humidity", "text"), 0), (reading("5", "cooler_door", 9e9, "2024-05-01T13:00:00Z"), 0)])
    c = sensors.clean(b)
    assert {(r.reading_id, r.is_anomaly) for r in c.collect()} == {("1", False), ("2", True), ("5", False)}
    h = {r.sensor_type: r for r in sensors.hourly(c).collect()}
    assert h["temperature"].reading_count == 2 and h["temperature"].anomaly_count == 1 and h["cooler_door"].hour == at(60)
    assert sensors.gaps(c, 3599).count() == 1 and sensors.gaps(c, 3600).count() == 0 and sensors.jumps(c, 1.0).count() == 1
    z = sensors.clean(landed(spark, [(reading("1", "temperature", 50.0, zone="cooler"), 0), (reading("2", "temperature", 50.0, zone=None), 0)]), sensors.zone_rule())
    assert {(r.reading_id, r.is_anomaly) for r in z.collect()} == {("1", True), ("2", False)}


def test_trips(spark):
    def ping(d, m, lat, lon):
        return ({"delivery_id": d, "order_id": "UE-1", "driver_id": "x", "lat": lat, "lon": lon, "speed_mph": 10.0, "event_timestamp": at(m).strftime("%Y-%m-%dT%H:%M:%SZ"), "sync_timestamp": None}, 0)

    p = trips.pings(landed(spark, [ping("a", 0, 0.0, 0.0), ping("a", 10, 0.0, 180.0), ping("a", 10, 0.0, 180.0), ping("b", 0, 1.0, 1.0), ping("c", 0, 999.0, 0.0)]))
    t = trips.summarise(p).collect()
    assert [r.delivery_id for r in t] == ["a"] and abs(t[0].distance_km - 20015.087) < 0.01 and t[0].duration_minutes == 10 and t[0].ping_count == 2 and t[0].avg_speed_kmh == 16.09
    f = spark.createDataFrame([("uber_eats_UE-1", 7, 8)], "platform_order_id string, kitchen_key long, zone_key long")
    assert trips.link_orders(trips.summarise(p), f).first().kitchen_key == 7
    assert trips.path_distance(p).filter("delivery_id = 'b'").first().path_km == 0
    # two platforms with one id: the trip stays one, and the full id that comes first stands for it
    f = spark.createDataFrame([("uber_eats_UE-1", 7, 8), ("doordash_UE-1", 5, 6)], "platform_order_id string, kitchen_key long, zone_key long")
    linked = trips.link_orders(trips.summarise(p), f).collect()
    assert [(r.kitchen_key, r.zone_key) for r in linked] == [(5, 6)]
    zone = spark.createDataFrame([(6, "z6", "z", "c"), (8, "z8", "z", "c")], "zone_key long, zone_id string, zone_name string, city string")
    assert [(r.zone_id, r.trip_count) for r in marts.delivery_by_zone(trips.summarise(p), f, zone).collect()] == [("z6", 1)]


def test_states_and_facts(spark):
    ev = spark.createDataFrame([("o", "placed", at(0), "K-1"), ("o", "ready", at(5), "K-1"), ("o", "delivered", at(9), "K-1"), ("p", "placed", at(0), "K-9"), ("p", "cancelled", at(1), "K-9")], "order_id string, status string, status_timestamp timestamp, kitchen_id string")
    k = spark.createDataFrame([("K-1", 1)], "kitchen_id string, kitchen_key long")
    h = {(r.order_id, r.status): r for r in facts.state_history(ev, k).collect()}
    assert h["o", "ready"].previous_status == "placed" and h["o", "ready"].time_in_previous_status_seconds == 300 and h["o", "delivered"].is_current and h["p", "placed"].kitchen_key == -1
    s = {r.order_id: r for r in facts.final_state(ev).collect()}
    assert s["o"].delivery_seconds == 540 and s["p"].is_cancelled and s["p"].final_status == "cancelled"


def test_dimensions(spark):
    d = dims.date(spark)
    assert d.count() == 1096 and d.filter("is_weekend").first().day_of_week in (1, 7)
    t = dims.time(spark)
    assert t.count() == 1440 and t.select("time_key").distinct().count() == 1440 and t.filter("time_key = 500").first().time_of_day == "morning"
    cities = spark.createDataFrame([("X",), ("X",)], "city string")
    z = dims.zone(cities, {"A-B": 2.0})
    assert dims.zone(cities, {"A-B": 9.0}, z).first().avg_delivery_radius_km == 2.0


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "a", True, 1.0), (1, None, True, 30.0), (2, "zz", False, 31.0)], "k int, s string, is_current boolean, v double")
    rules = [
        quality.Rule("not_null", "s"), quality.Rule("between", "k", {"min": 1, "max": 1}), quality.Rule("in_set", "s", {"values": ["a"]}), quality.Rule("match", "s", {"regex": "^.$"}),
        quality.Rule("not_match", "s", {"regex": "z"}), quality.Rule("unique", "k"), quality.Rule("row_count", args={"n": 3}), quality.Rule("one_current", "k"),
        quality.Rule("has_state", "k", {"state_column": "s", "state": "a"}), quality.Rule("columns", args={"names": ["k", "gone"]}),
        quality.Rule("rate_between", "s", {"flag": F.col("s").isNull(), "min": 0.1, "max": 0.5}), quality.Rule("drift_below", "v", {"by": "k", "order": ["v"], "limit": 20}),
    ]
    got = {r.rule: (r.success, r.unexpected_count) for r in quality.run(df, "x", rules).collect()}
    assert got == {"not_null": (False, 1), "between": (False, 1), "in_set": (False, 1), "match": (False, 1), "not_match": (False, 1), "unique": (False, 2), "row_count": (True, 0), "one_current": (False, 2), "has_state": (False, 1), "columns": (False, 1), "rate_between": (True, 1), "drift_below": (False, 1)}
    none = {r.rule: r.success for r in quality.run(df.filter("false"), "x", rules[:8]).collect()}
    assert none["not_null"] and none["unique"] and not none["row_count"]
    with pytest.raises(ValueError):
        quality.run(df, "x", [])


def test_health(spark):
    df = spark.createDataFrame([(1, "a@b", at(0)), (1, "c", at(1))], "k int, s string, ts timestamp")
    dim = spark.createDataFrame([(2,)], "k int")
    assert health.orphans(df, dim, "k", "k").first().status == "fail" and health.grain(df, ["k"]).first().duplicates == 1
    assert health.pii_scan({"t": df}).first().leaks == 1
    status = lambda m: health.freshness(df, "ts", F.lit(at(m))).first().status
    assert (status(2), status(300), status(5000)) == ("pass", "warn", "fail")
    assert health.verdict(health.row_counts({"t": df}, {"t": 9})).first().verdict == "failed"
    days = spark.createDataFrame([(T0 + dt.timedelta(days=d),) for d in range(8) for _ in range(10 if d < 7 else 2)], "ts timestamp")
    assert [r.is_drop for r in health.count_drop(days, "ts").orderBy("day").collect()] == [False] * 7 + [True]


def test_streams_agree_with_batch(spark, tmp_path):
    raw = spark.createDataFrame([(b"k", b'{"n": 1}', "t", 0, i, T0 + dt.timedelta(minutes=20 * i), 0) for i in range(12)], bronze.STREAM_SCHEMA)
    raw.write.parquet(f"{tmp_path}/in")
    src = lambda: bronze.read_stream(spark, "t", fmt="parquet", path=f"{tmp_path}/in")
    stream.finish(stream.ingest(src(), f"{tmp_path}/bronze", f"{tmp_path}/c1", {"availableNow": True}, F.col("timestamp")), 120)
    land = spark.read.parquet(f"{tmp_path}/bronze")
    batch = bronze.envelope(raw, F.col("timestamp"))
    assert sorted(r.kafka_offset for r in land.collect()) == list(range(12)) and land.select("raw_value").distinct().first()[0] == batch.first().raw_value
    hours = stream.run_once(spark, stream.rollup(src(), ["topic"], "timestamp", "offset", "0 seconds"), f"{tmp_path}/o2", f"{tmp_path}/c2", 120)
    assert [(r.hour, r.reading_count) for r in hours.orderBy("hour").collect()] == [(at(0), 3), (at(60), 3), (at(120), 3)]
    once = stream.run_once(spark, stream.dedup(src(), ["topic"], "timestamp").select("topic"), f"{tmp_path}/o3", f"{tmp_path}/c3", 120)
    assert once.count() == 1
    last = lambda b: b.groupBy("topic").agg(F.max("offset").alias("offset"))
    q = src().writeStream.foreachBatch(stream.upsert_sink(f"{tmp_path}/u", ["topic"], last)).option("checkpointLocation", f"{tmp_path}/c4").trigger(availableNow=True).start()
    stream.finish(q, 120)
    assert spark.read.parquet(f"{tmp_path}/u/{q.lastProgress.batchId}").first().offset == 11
    day = batch.withColumn("d", F.col("ingestion_date"))
    stream.replace_partitions(day, f"{tmp_path}/p", "d")
    stream.replace_partitions(day.limit(1), f"{tmp_path}/p", "d")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1
    assert stream.reconcile(batch, "2024-05-01 13:00:00", 1, lambda b: b).count() == 4
    assert stream.backfill(batch, "2024-05-02", "2024-05-03", lambda b: b).count() == 0


def test_seeds_and_export(spark, tmp_path):
    (tmp_path / "s.csv").write_text("BRAND_ID,brand_name,cuisine_type,launch_date,is_active\nb1,B,thai,2024-01-01,true\n")
    seed = bronze.read_seed(spark, f"{tmp_path}/s.csv", bronze.BRAND_SCHEMA)
    assert dims.from_seed(seed, "brand_id", "brand_key").first().brand_key >= 0
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = "jdbc:derby:memory:t1;create=true"
    good, bad = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([([1],)], "a array<int>")
    rows = {r.table_name: r.success for r in export.export_tables(spark, {"BAD": bad, "GOOD": good}, url, props, partitions=1).collect()}
    assert rows == {"GOOD": True, "BAD": False}
    assert spark.read.jdbc(url, "GOOD", properties=props).count() == 1


def test_change_batches_give_the_history_of_the_whole_log(spark):
    import random

    r = random.Random(6)
    log = []
    for k in "abc":
        times = sorted(r.sample(range(1, 60), 9))
        alive = False
        for n, t in enumerate(times):
            op = "c" if not alive else r.choice(["u", "u", "d"])
            alive = op != "d"
            log.append((op, t * 1000, n, k, f"{k}{n}"))
    df = lambda rows: spark.createDataFrame(rows, "op string, ts_ms long, seq long, k string, v string")
    plain = lambda h: sorted((x.k, x.v, x.effective_start, x.effective_end, x.is_current) for x in h.collect())
    want = plain(cdc.to_history(df(log), ["k"]))
    held = [x for x in log if x[0] == "u" and r.random() < 0.4]  # updates that come late, and one batch twice
    soon = [x for x in sorted(log, key=lambda x: x[1]) if x not in held]
    now = None
    for part in (soon[:9], soon[9:18], soon[5:12], soon[18:] + held[::2], held):
        now = cdc.apply_changes(now, df(part), ["k"])
        now = spark.createDataFrame(now.collect(), now.schema)
    assert plain(now) == want
    assert now.filter("is_current").groupBy("k").count().filter("count > 1").count() == 0


def test_late_changes_are_what_scd2_ignores(spark):
    df = lambda rows: spark.createDataFrame([(k, v, at(m)) for k, v, m in rows], "k string, v string, ts timestamp")
    one = upsert.scd2_apply(None, df([("a", "A", 0), ("a", "B", 10), ("b", "x", 5)]), ["k"], ["v"], "ts")
    new = df([("a", "A", 0), ("a", "C", 5), ("a", "D", 20), ("b", "y", 5), (None, "z", 0), ("c", "n", 0)])
    assert {(r.k, r.v) for r in upsert.late_changes(one, new, ["k"], ["v"], "ts").collect()} == {("a", "C"), ("b", "y")}


def test_seed_repeats_and_default_zone(spark):
    seed = spark.createDataFrame([("k1", "old", 1), ("k1", "new", 2), ("k2", "x", None), (None, "y", 9)], "id string, name string, n int")
    assert {(r.id, r.name) for r in dims.from_seed(seed, "id", "key", "n").collect()} == {("k1", "new"), ("k2", "x")}
    assert dims.from_seed(seed, "id", "key").count() == 2
    kitchens = spark.createDataFrame([("K-1", "X"), ("K-2", "Y")], "kitchen_id string, city string")
    zones = spark.createDataFrame([("X-DOWNTOWN", "X"), ("X-UPTOWN", "X")], "zone_id string, city string")
    orders = spark.createDataFrame([(1, "K-1", None), (2, "K-1", "X-UPTOWN"), (3, "K-2", None), (4, None, None)], "o int, kitchen_id string, zone_id string")
    assert {(r.o, r.zone_id) for r in facts.default_zone(orders, kitchens, zones).collect()} == {(1, "X-DOWNTOWN"), (2, "X-UPTOWN"), (3, None), (4, None)}


def test_fuzzy_in_a_block_of_one_prefix(spark):
    names = [f"kitchen {i * 7919 % 100003}" for i in range(150)] + ["kitchen 1", "kitchen 1", "kitchen 10"]
    df = spark.createDataFrame([(i, "z", n) for i, n in enumerate(names)], "id int, b string, name string")
    got = identity.fuzzy(df, "id", "name", ["b"], 1)
    every = df.alias("x").join(df.alias("y"), F.expr("x.id < y.id and levenshtein(x.name, y.name) <= 1"))
    want = {(r[0], r[1]) for r in every.select("x.id", "y.id").collect()}
    assert {(r.a, r.b_) for r in got.collect()} == want and {(150, 151), (150, 152)} <= want
    assert got.columns[0] == "b"


def test_records_are_parsed_once(spark):
    b = landed(spark, [(uber("1"), 0)])
    for df in (align.placed_orders(b), align.align(b), align.status_events(b)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(StructField") + plan.count("jsontostructs(StructField") <= 1, plan


def test_connection_and_schema_merge(spark, tmp_path):
    url, props = export.connection({"EXPORT_JDBC_URL": "jdbc:x", "EXPORT_JDBC_USER": "u", "EXPORT_JDBC_PASSWORD": "p"})
    assert url == "jdbc:x" and props == {"user": "u", "password": "p"}
    with pytest.raises(KeyError):
        export.connection({})
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    bronze.write_table(a, f"{tmp_path}/t")
    bronze.write_table(b, f"{tmp_path}/t", "append")
    assert {tuple(r) for r in bronze.read_table(spark, f"{tmp_path}/t", mergeSchema="true").select("a", "b").collect()} == {(1, None), (2, "x")}


def test_views_are_ordered(spark):
    d = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2))], "date_key int, full_date date").selectExpr("*", "2024 year", "1 month", "1 day_of_month", "false is_weekend")
    k = spark.createDataFrame([(7, "K", "n", "c", "s"), (8, "L", "n", "c", "s")], "kitchen_key int, kitchen_id string, name string, city string, state string")
    f = spark.createDataFrame([(1, 7, 5, 1, False), (2, 7, 1, 1, False), (2, 8, 3, 1, True)], "date_key int, kitchen_key int, order_total_cents long, item_count int, is_cancelled boolean")
    rows = marts.revenue_by_kitchen_day(f, d, k).collect()
    assert [(str(r.order_date), r.total_revenue_cents) for r in rows] == [("2024-01-02", 3), ("2024-01-02", 1), ("2024-01-01", 5)]
