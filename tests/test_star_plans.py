"""What the layers of the star schema shuffle and sort, read from their plans."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tidewright.operators import align, cdc, dedup, distinct, facts, identity
from tidewright.plans.star import Star
from tidewright.sources import feeds

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


@tables
def test_order_fact_is_shuffled_by_order_alone(spark):
    star = Star(spark, SF)
    assert all("order_id" in e for e in exchanges(star._gold_fact_order()))
    assert len(exchanges(facts.state_history(star.events(), star.kitchen()))) == 1


@tables
def test_landed_orders_are_sorted_by_day_before_their_payload_is_made(spark):
    p = plan(Star(spark, SF)._landed_orders())
    assert p.index("StructsToJson") < p.index("Sort [ingestion_date") < p.index("Exchange hashpartitioning(ingestion_date")
    assert "StructsToJson" not in p[p.index("Exchange hashpartitioning(ingestion_date"):]


@tables
def test_menu_log_reads_line_items_once(spark):
    p = plan(feeds.menu_records(spark, SF))
    assert p.count("l_shipdate") and len(re.findall(r"FileScan parquet[^\n]*l_shipdate", p)) == 1 and p.count("Window") == 1


def test_first_of_a_key_is_sorted_once(spark):
    df = spark.range(10).selectExpr("id % 3 k", "id v")
    first = dedup.dedup_first(df, ["k"], ["v"])
    assert plan(first).count("Sort [") == 1 and "WindowGroupLimit" not in plan(first)
    assert sorted(map(tuple, first.collect())) == [(0, 0), (1, 1), (2, 2)]


def test_hashes_are_not_shuffled_with_orders(spark):
    raw = '{"platform":"doordash","order_id":"1","order_value":2,"created_at":"2000-01-01T00:00:00Z","dasher_customer_id":"a"}'
    b = spark.createDataFrame([(raw, 2), (raw, 1)], "raw_value string, kafka_offset long").withColumn("ingestion_timestamp", F.lit("2000-01-01").cast("timestamp"))
    p = plan(align.align(b))
    assert "sha2" in p and "sha2" not in p[p.index("Exchange hashpartitioning"):]
    assert [r.platform_order_id for r in align.align(b).collect()] == ["doordash_1"]


def test_history_is_shuffled_once_and_repeats_are_no_changes(spark):
    log = spark.createDataFrame([("a", "c", 1, 1, 5), ("a", "c", 1, 1, 5), ("a", "u", 2, 2, 6), ("a", "u", 2, 2, 6), ("a", "d", 3, 3, 6), ("a", "d", 3, 3, 6)], "k string, op string, ts_ms long, seq long, v int")
    h = cdc.to_history(log, ["k"])
    assert len(exchanges(h)) == 1
    assert sorted((r.v, r.is_current) for r in h.collect()) == [(5, False), (6, False)]


def test_bitmaps_are_made_after_the_shuffle(spark):
    rows = spark.range(100).selectExpr("id % 50 day", "id v")
    made = distinct.bitmaps(rows, ["day"], spark.range(100).selectExpr("id v", "id * 40000 id"), "v")
    p = plan(made)
    assert "bitmap_construct_agg" not in p[p.index("Exchange hashpartitioning(day"):]
    assert {tuple(r) for r in distinct.counts(made, ["day"]).collect()} == {(d, 2) for d in range(50)}


def test_near_names_are_compared_in_all_partitions_and_gathered_if_near(spark):
    df = spark.createDataFrame([(1, "abcd"), (1, "abce"), (1, "xycd"), (1, "zz")], "b int, n string")
    near = identity.near_names(df, ["b"], "n", 2)
    p = plan(near)
    assert {(r.n, r["__other"], r.distance) for r in near.collect()} == {("abcd", "abcd", 0), ("abce", "abce", 0), ("xycd", "xycd", 0), ("zz", "zz", 0), ("abcd", "abce", 1), ("abcd", "xycd", 2)}
    assert "REPARTITION_BY_NUM" in p and "levenshtein" not in p[:p.index("Exchange hashpartitioning(b")] and "levenshtein" in p
