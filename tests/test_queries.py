"""Registered queries against their SQL on the smallest tables, and what makes them one set."""

import math
import os

import pandas as pd
import pytest

from tidewright.plans.oracles import ORACLES
from tidewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
SOME = [
    "orders_dedup", "identity_bridge_two_batches", "sat_order_scd2_two_batches", "sat_customer_profile", "fact_order", "order_state_history", "menu_cdc_history",
    "pit_menu_join", "sensor_hourly", "delivery_trips", "rev_kitchen_day", "dq_dim_menu_item", "pii_scan", "stream_hourly", "reconcile_48h", "identity_fuzzy",
    "menu_cdc_two_batches", "sat_order_late_changes", "fact_order_default_zone", "fact_sensor_hourly", "seed_last_wins", "schema_merge", "dq_more", "dq_pass_rate", "stream_sliding", "replace_partitions", "health_verdict",
    "stream_upsert", "sensor_offline_alarms", "stream_order_pickups", "sat_order_bitemporal", "orders_quarantine", "dq_observed_write", "nightly_reconciliation",
    "identity_people", "rev_kitchen_day_incremental", "rev_brand_day_incremental", "unique_customers_rollup", "top_customers", "fact_order_final_state", "backfill_range",
    "row_counts_gold", "bronze_samples",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if pd.isna(v):
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0 if math.isfinite(v) else v
    s = str(v)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else s.removesuffix(" 00:00:00") if s != "NaT" else None


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame.astype(object)[columns].itertuples(index=False)), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a, b = rows(got.toPandas(), columns), rows(want.df(), columns)
    assert a == b


def test_entry_and_contract(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
