"""Identities, quarantine, observed writes, reconciliation, bitmaps, incremental views, pruned landing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import align, distinct, health, identity, quality, upsert, vault
from tidewright.plans import incremental
from tidewright.plans.registry import QUERIES
from tidewright.plans.star import Star
from tidewright.sources import bronze, snapshots
from tidewright.streaming import stream

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 5, 1, 12)
at = lambda h: T0 + dt.timedelta(hours=h)
PEOPLE = "id long, email string, name string, street string"


def who(df):
    return {r.id: (r.identity_key, r.match_method, r.match_confidence) for r in df.collect()}


def test_identities_by_email_name_and_hand(spark):
    people = spark.createDataFrame(
        [
            (1, " Ann@X.org", "Ann Lee", "a"), (2, "ann@x.org", "A. Lee", "b"), (3, None, "ann lee", "a"), (4, None, "anm lee", "a"), (5, None, "anm leo", "a"), (6, None, "ann lee", "b"),
            (7, "bob@x.org", "Bob Ray", "c"), (8, "rob@x.org", "Rob Ray", "c"), (9, None, "Cob Ray", "c"), (10, None, None, "c"), (11, None, "Zed", None), (12, None, "zed", None), (13, "", "Solo", "q"),
        ],
        PEOPLE,
    )
    got = who(identity.identities(people, "id", "email", "name", ["street"]))
    ann = got[1][0]
    assert got[1] == got[2] == (ann, "exact_email", 1.0)
    assert got[3] == (ann, "fuzzy_name_address", 0.9) and got[4] == (ann, "fuzzy_name_address", 0.8) and got[5] == (ann, "fuzzy_name_address", 0.8)  # 5 by way of 4
    assert got[6][0] != ann and got[6][1:] == ("platform_id_fallback", 0.6)  # another street
    assert got[9][0] == got[7][0] != got[8][0]  # as near to both: the lesser email, and the two stay apart
    assert got[10][1] == "platform_id_fallback" and got[11][0] == got[12][0] and got[13][1:] == ("platform_id_fallback", 0.6)
    assert len(got) == 13
    # keys survive, the least of a group's; a person set by hand stays there
    known = spark.createDataFrame([(4, "old b"), (2, "old a"), (12, "old z"), (99, "gone")], "id long, identity_key string")
    by_hand = spark.createDataFrame([(5, "hand"), (10, "hand")], "id long, identity_key string")
    again = who(identity.identities(people, "id", "email", "name", ["street"], known=known, overrides=by_hand))
    assert {again[i][0] for i in (1, 2, 3, 4)} == {"old a"} and again[5] == again[10] == ("hand", "manual_override", 1.0) and again[11][0] == again[12][0] == "old z"
    assert identity.identities(people.filter("false"), "id", "email", "name", ["street"]).count() == 0


def test_a_common_name_costs_a_row_each(spark):
    crowd = spark.range(100_000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("m"), "id")).alias("email"), F.lit("jan smit").alias("name"), F.lit("x").alias("street"))
    out = identity.identities(crowd, "id", "email", "name", ["street"])
    assert out.count() == 100_000 and out.groupBy("match_method").count().count() == 2
    assert out.filter("match_method = 'fuzzy_name_address'").select("identity_key").distinct().count() == 1


def record(raw, n=0):
    return (raw.encode(), "orders", n, T0)


def test_broken_records_are_told_from_good_ones(spark):
    rows = [
        ('{"order_id": "1", "platform": "uber_eats", "order_timestamp": "2024-05-01T12:00:00Z", "total_amount": 3.5}', None),
        ('{"order_id": "1", "platform": "own_app", "event_type": "status_change", "status": "ready", "status_timestamp": "2024-05-01T12:00:00Z"}', None),
        ("{", "not_json"), ("", "not_json"), ("[]", "not_json"), ('{"order_id": "1"}', "unknown_platform"), ('{"order_id": "1", "platform": "x"}', "unknown_platform"),
        ('{"order_id": "1", "platform": "own_app", "event_type": "y"}', "unknown_event"), ('{"platform": "own_app", "timestamp": "2024-05-01"}', "no_order_id"),
        ('{"order_id": "1", "platform": "own_app", "timestamp": "yesterday", "amount_cents": 3}', "bad_timestamp"), ('{"order_id": "1", "platform": "own_app", "timestamp": "2024-05-01", "amount_cents": "3.x"}', "bad_total"),
        ('{"order_id": "1", "platform": "own_app", "event_type": "status_change", "status_timestamp": "2024-05-01T12:00:00Z"}', "no_status"),
    ]
    df = spark.createDataFrame([(raw, i) for i, (raw, _) in enumerate(rows)] + [(None, 99)], "raw_value string, n int")
    got = {r.n: r.fault for r in align.faults(df).collect()}
    assert got == {i: f for i, (_, f) in enumerate(rows)} | {99: "not_json"}


def test_rules_are_counted_by_the_scan_that_writes(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id")).alias("v"))
    rules = [quality.Rule("not_null", "v"), quality.Rule("between", "v", {"min": 0, "max": 90})]
    got = quality.observed_write(df, lambda x: x.write.parquet(f"{tmp_path}/t"), "t", rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.run(df, "t", rules).collect())) and spark.read.parquet(f"{tmp_path}/t").count() == 100
    with pytest.raises(ValueError):
        quality.observed_write(df, lambda x: None, "t", [quality.Rule("unique", "id")])


def test_reconciliation_reads_and_replaces_its_days_alone(spark, tmp_path):
    raw = spark.createDataFrame([(b"k", str(i).encode(), "t", 0, i, at(6 * i), 0) for i in range(20)], bronze.STREAM_SCHEMA)
    bronze.envelope(raw, F.col("timestamp")).write.partitionBy("ingestion_date").parquet(f"{tmp_path}/landed")
    landed = spark.read.schema(bronze.envelope(raw, F.col("timestamp")).schema).parquet(f"{tmp_path}/landed")
    table = snapshots.Snapshots(spark, f"{tmp_path}/table")
    build = lambda factor: lambda b: b.groupBy("ingestion_date").agg((F.sum(F.col("raw_value").cast("long")) * factor).alias("v"))
    table.replace(build(1)(landed), "ingestion_date")
    read = lambda: {r.ingestion_date: r.v for r in table.read("v long", "ingestion_date").collect()}
    before = read()
    stream.reconcile_into(table, landed, "2024-05-04 01:00:00", 48, build(100))
    assert read() == {d: v * (100 if "2024-05-02" <= d <= "2024-05-04" else 1) for d, v in before.items()}
    with pytest.raises(Exception, match="broken"):
        stream.reconcile_into(table, landed, "2024-05-04 01:00:00", 48, lambda b: build(7)(b).withColumn("v", F.raise_error("broken").cast("long")))
    assert read() == {d: v * (100 if "2024-05-02" <= d <= "2024-05-04" else 1) for d, v in before.items()}


def test_landed_orders_are_pruned_by_day(spark):
    s = Star(spark, SF)
    plan = stream.reconcile(s.bronze_orders(), "1999-06-01 12:00:00", 48, align.align)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "ingestion_date" in filters and "1999-05-30" in filters
    days = stream.in_range(s.bronze_orders(), "1999-05-30", "1999-06-01")
    assert {r.ingestion_date for r in days.select("ingestion_date").distinct().collect()} <= {"1999-05-30", "1999-05-31", "1999-06-01"}


def test_bitmaps_count_like_sets(spark):
    r = random.Random(4)
    rows = [(f"2024-05-{r.randrange(1, 20):02d}", r.choice("ab"), f"c{r.randrange(60_000)}") for _ in range(20_000)] + [("2024-05-01", "a", None)]
    df = spark.createDataFrame(rows, "day string, g string, who string")
    early = df.filter("day < '2024-05-10'")
    first = distinct.dense_ids(early, "who", cells=16)
    ids = distinct.dense_ids(df, "who", first, cells=16)
    n = len({w for *_, w in rows if w})
    assert sorted(x.id for x in ids.collect()) == list(range(n)) and first.join(ids, ["who", "id"]).count() == first.count()
    days = distinct.bitmaps(df, ["day", "g"], ids, "who")
    got = {(x.day, x.g): x.n_distinct for x in distinct.counts(days, ["day", "g"]).collect()}
    assert got == {k: len({w for d, g, w in rows if (d, g) == k and w}) for k in {(d, g) for d, g, w in rows if w}}
    week = {x.half: x.n_distinct for x in distinct.counts(distinct.merged(days, [(F.col("day") < "2024-05-10").alias("half")]), ["half"]).collect()}
    assert week == {h: len({w for d, _, w in rows if w and (d < "2024-05-10") == h}) for h in (True, False)}
    assert "Expand" not in days._jdf.queryExecution().executedPlan().toString()


FACT = "date_key int, kitchen_key long, order_total_cents long, item_count int, is_cancelled boolean, k int"


def test_signed_changes_equal_a_rebuild_and_read_changed_orders_only(spark):
    r = random.Random(3)
    order = lambda k: (20240501 + r.randrange(4), r.randrange(3), r.randrange(100, 900), r.randrange(1, 5), r.random() < 0.2, k)
    now, stored, keys = {}, None, incremental.KITCHEN_DAY
    frame = lambda rows: spark.createDataFrame(rows, FACT)
    for _ in range(3):
        changed = {k: order(k) for k in r.sample(range(60), 25)}
        before = [now[k] for k in changed if k in now]
        gone = r.sample([k for k in now if k not in changed], min(3, len(now)))  # taken back for good
        delta = incremental.deltas(frame(before + [now[k] for k in gone]), frame(list(changed.values())), keys)
        now = {k: v for k, v in (now | changed).items() if k not in gone}
        stored = incremental.merge(stored, delta, keys)
        want = incremental.deltas(None, frame(list(now.values())), keys)
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, want.select(*stored.columns).collect()))


def test_scd2_sorts_touched_keys_only(spark):
    schema = "k string, v string, ts timestamp"
    first = upsert.scd2_apply(None, spark.createDataFrame([(f"k{i}", "a", at(0)) for i in range(50)], schema), ["k"], ["v"], "ts")
    second = upsert.scd2_apply(first, spark.createDataFrame([("k1", "b", at(1)), ("new", "a", at(1))], schema), ["k"], ["v"], "ts")
    assert second.count() == 52 and second.filter("is_current").count() == 51
    assert sorted((x.k, x.v, x.effective_end) for x in second.filter("k in ('k1', 'k2')").collect()) == [("k1", "a", at(1)), ("k1", "b", None), ("k2", "a", None)]
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan


def test_session_rollup(spark, tmp_path):
    rows = [("a", at(0)), ("a", at(0.2)), ("a", at(3)), ("b", at(1)), ("b", at(1.4)), ("b", at(1.8)), ("z", at(50))]
    spark.createDataFrame(rows, "k string, ts timestamp").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("k string, ts timestamp").parquet(f"{tmp_path}/in")
    out = stream.run_once(spark, stream.session_rollup(src, ["k"], "ts", "30 minutes", "0 seconds"), f"{tmp_path}/o", f"{tmp_path}/c", 120)
    assert sorted((x.k, x.start, x.end, x.n) for x in out.collect()) == [("a", at(0), at(0.7), 2), ("a", at(3), at(3.5), 1), ("b", at(1), at(2.3), 3)]


def test_log_broker_options(monkeypatch):
    """The reader asks for what the landing needs; no broker is there to read from."""
    asked = {}

    class Reader:
        def format(self, name):
            asked["format"] = name
            return self

        def options(self, **kw):
            asked.update(kw)
            return self

        def load(self):
            return "stream"

    class Session:
        readStream = Reader()

    assert bronze.read_stream(Session(), "orders", "b:9092", maxOffsetsPerTrigger="5000") == "stream"
    assert asked == {"format": "kafka", "kafka.bootstrap.servers": "b:9092", "subscribe": "orders", "startingOffsets": "earliest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": "5000"}


def test_order_versions_follow_basket_and_zone(spark):
    """A basket of equal size and total and another zone open versions; the same record again, or nulls again, open none."""
    schema = "platform_order_id string, customer_key string, order_total_cents long, order_timestamp timestamp, kitchen_id string, brand_name string, zone_id string, items_json string, item_count int, is_late_arriving boolean, ingestion_timestamp timestamp"

    def batch(h, *orders):
        return spark.createDataFrame([(o, "c", 100, at(0), "K", "b", zone, items, 1, False, at(h)) for o, zone, items in orders], schema)

    sat = vault.sat_order_details(None, batch(1, ("a", "z", "[1]"), ("b", "z", "[1]"), ("c", None, None)))
    sat = vault.sat_order_details(sat, batch(2, ("a", "z", "[2]"), ("b", "y", "[1]"), ("c", None, None)))
    sat = vault.sat_order_details(sat, batch(3, ("a", "z", "[2]"), ("c", None, None)))
    got = sorted((r.zone_id or "", r.items_json or "", r.effective_start, r.is_current) for r in sat.collect())
    assert got == [("", "", at(1), True), ("y", "[1]", at(2), True), ("z", "[1]", at(1), False), ("z", "[1]", at(1), False), ("z", "[2]", at(2), True)]


def test_samples_hold_a_whole_record_of_every_partition(spark):
    rows = [("2024-05-01", "10", 5, at(0), "five"), ("2024-05-01", "10", 3, at(1), "three"), ("2024-05-01", "11", 9, at(2), None)]
    landed = spark.createDataFrame(rows, "ingestion_date string, ingestion_hour string, kafka_offset long, kafka_timestamp timestamp, raw_value string")
    got = {(r.ingestion_hour, r.n, r.kafka_offset, r.raw_value) for r in health.bronze_samples(landed).collect()}
    assert got == {("10", 2, 3, "three"), ("11", 1, 9, None)} and health.bronze_samples(landed.limit(0)).count() == 0


def test_all_new_queries_are_registered():
    new = {"sensor_offline_alarms", "stream_order_pickups", "sat_order_bitemporal", "orders_quarantine", "dq_observed_write", "nightly_reconciliation", "identity_people", "rev_kitchen_day_incremental", "rev_brand_day_incremental", "unique_customers_rollup"}
    assert new <= set(QUERIES)
