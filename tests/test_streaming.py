"""Stateful streams: batches in any order, late rows, restarts, bounded state."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewright.sources import snapshots
from tidewright.streaming import alarms, joins, stream

T0 = dt.datetime(2024, 5, 1, 12)
at = lambda s: T0 + dt.timedelta(seconds=s)


def feed(spark, path, schema, *files):
    """Write one Parquet file after the other, so that a stream of one file a trigger reads them in this order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


READING = "sensor_id string, ts timestamp"


def test_alarms_equal_the_batch_answer_in_any_order(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"s{k % 5}", at(r.randrange(20_000))) for k in range(150)] + [("only", at(50)), ("s1", at(20_000))]
    by_time = sorted(rows, key=lambda x: x[1])
    files = []
    for k in range(0, len(by_time), 40):  # within a file any order; neighbours of a border change places
        part = by_time[k : k + 40]
        r.shuffle(part)
        files.append(part)
    src = feed(spark, f"{tmp_path}/in", READING, *files, [(None, at(3)), ("s2", None)])
    run = lambda s: alarms.offline_alarms(s, "sensor_id", "ts", 600, "0 seconds")
    got = stream.run_once(spark, run(src()), f"{tmp_path}/out", f"{tmp_path}/c", 240)
    want = alarms.silences(spark.createDataFrame(rows, READING), "sensor_id", "ts", 600)
    assert plain(got) == plain(want) and got.filter("sensor_id = 'only'").count() == 1


def test_alarms_go_on_from_the_checkpoint(spark, tmp_path):
    run = lambda: alarms.offline_alarms(spark.readStream.schema(READING).parquet(f"{tmp_path}/in"), "sensor_id", "ts", 60, "5 seconds")
    feed(spark, f"{tmp_path}/in", READING, [("a", at(0)), ("b", at(10)), ("b", at(100))])
    first = plain(stream.run_once(spark, run(), f"{tmp_path}/out", f"{tmp_path}/c", 120))
    assert first == [("a", at(0), at(60)), ("b", at(10), at(70))]  # both silent past their limit; a still is
    feed(spark, f"{tmp_path}/in", READING, [("a", at(300)), ("b", at(101)), ("b", at(110)), ("late", at(1))])
    feed(spark, f"{tmp_path}/in", READING, [("a", at(310)), ("c", at(900))])
    again = plain(stream.run_once(spark, run(), f"{tmp_path}/out", f"{tmp_path}/c", 120))
    assert again == sorted([*first, ("b", at(110), at(170)), ("a", at(310), at(370))], key=repr)  # nothing twice, the late row is gone


def test_silence_is_the_same_for_every_cut_into_steps():
    r = random.Random(8)
    for _ in range(300):
        times = sorted(r.sample(range(100), r.randrange(1, 9)))
        want = [t for t, n in zip(times, [*times[1:], 10**6], strict=True) if n > t + 10 and t + 10 < 95]
        machine, got, clock = alarms.Silence(10), [], 0
        left = list(times)
        while clock < 95:
            clock = min(95, clock + r.randrange(1, 30))
            come = [t for t in left if t <= clock + r.randrange(0, 20)]
            left = [t for t in left if t not in come]
            got += machine.advance([*come, *come[:1]], clock)
        assert sorted(got) == [t for t in want if t <= 95], (times, got, want)


ORDER, PICKUP = "order_id string, placed timestamp", "order_id string, picked timestamp"


def test_interval_join_equals_the_batch_answer_with_late_rows(spark, tmp_path):
    orders = [[("o1", at(0)), ("o2", at(10)), ("o3", at(20))], [("o4", at(4000))], [("o5", at(9000))], [("late", at(30)), ("o7", at(9500))], [("o6", at(20_000))]]
    picks = [[("o1", at(600)), ("o4", at(4001))], [("o2", at(5000))], [("o5", at(9600))], [("o3", at(700)), ("o9", at(9700))], [("o6", at(20_001))]]
    left, right = feed(spark, f"{tmp_path}/l", ORDER, *orders)(), feed(spark, f"{tmp_path}/r", PICKUP, *picks)()
    out = joins.interval_join(left, right, ["order_id"], "placed", "picked", "0 seconds", "1 hour", "10 minutes", "10 minutes")
    q = stream.sink(out, f"{tmp_path}/out", f"{tmp_path}/c", {"availableNow": True})
    stream.finish(q, 240)
    got = {tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    # o2's pickup comes after the hour, o3's behind the watermark, o7's never: these orders are given without one
    assert got == {("o1", at(0), at(600)), ("o4", at(4000), at(4001)), ("o5", at(9000), at(9600)), ("o2", at(10), None), ("o3", at(20), None), ("o7", at(9500), None), ("o6", at(20_000), at(20_001))}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 10
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3
    batch = joins.interval_join(spark.read.schema(ORDER).parquet(f"{tmp_path}/l").filter("order_id <> 'late'"), spark.read.schema(PICKUP).parquet(f"{tmp_path}/r").filter("order_id <> 'o3'"), ["order_id"], "placed", "picked", "0 seconds", "1 hour")
    assert {tuple(x) for x in batch.collect()} == got


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    schema = "k long, v long, ts long"
    base = f"{tmp_path}/t"
    last = lambda b: b.groupBy("k").agg(F.max_by("v", "ts").alias("v"), F.max("ts").alias("ts"))
    sink = stream.bucket_upsert_sink(base, ["k"], last, buckets=8, keep=2)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    sink(frame([(k, k, 0) for k in range(100)]), 0)
    table = snapshots.Snapshots(spark, base)
    before = table.parts()
    sink(frame([(3, 33, 1), (3, 34, 2), (200, 1, 1)]), 1)
    after = table.parts()
    touched = {r[0] for r in frame([(3, 0, 0), (200, 0, 0)]).select(stream.bucket(["k"], 8)).collect()}
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched} and len(touched) < 8
    read = lambda: {r.k: r.v for r in table.read(schema).collect()}
    want = {k: k for k in range(100)} | {3: 34, 200: 1}
    assert read() == want
    sink(frame([(3, 99, 9)]), 1)  # a batch that is replayed after it was published changes nothing
    assert read() == want and table.parts() == after
    for n in range(2, 6):
        sink(frame([(3, n, n + 10)]), n)
    assert read() == want | {3: 5}
    kept = {p for v in table.versions()[-2:] for p in table.parts(v).values()}
    on_disk = {f"{d.parent.parent.name}/{d.parent.name}" for d in tmp_path.glob("t/data/*/*/*.parquet")}
    assert on_disk == {"/".join(p.rstrip("/").split("/")[-2:]) for p in kept}  # older files are gone
    assert table.versions() == [4, 5]


def test_failed_batch_leaves_the_old_snapshot(spark, tmp_path):
    base, schema = f"{tmp_path}/t", "k long, v long"
    good = stream.bucket_upsert_sink(base, ["k"], lambda b: b, buckets=4)
    good(spark.createDataFrame([(1, 1), (2, 2)], schema), 0)
    bad = stream.bucket_upsert_sink(base, ["k"], lambda b: b.withColumn("v", F.raise_error("no").cast("long")), buckets=4)
    with pytest.raises(Exception, match="no"):
        bad(spark.createDataFrame([(1, 5)], schema), 1)
    table = snapshots.Snapshots(spark, base)
    assert table.versions() == [0] and {r.k: r.v for r in table.read(schema).collect()} == {1: 1, 2: 2}
    good(spark.createDataFrame([(1, 7)], schema), 1)
    assert {r.k: r.v for r in table.read(schema).collect()} == {1: 7, 2: 2}


def test_reader_during_a_replacement_sees_old_or_new(spark, tmp_path):
    base = f"{tmp_path}/t"
    table = snapshots.Snapshots(spark, base)
    days = lambda v: spark.createDataFrame([(f"2024-05-0{d}", d, v) for d in (1, 2, 3)], "day string, n long, v string")
    table.replace(days("old"), "day")
    before = table.read("n long, v string", part="day", kind="string")  # planned before, read after the swap
    table.replace(days("new").filter("n > 1"), "day")
    assert plain(before.select("day", "v")) == [(f"2024-05-0{d}", "old") for d in (1, 2, 3)]
    assert plain(table.read("n long, v string", part="day", kind="string").select("day", "v")) == [("2024-05-01", "old"), ("2024-05-02", "new"), ("2024-05-03", "new")]
    plan = table.read("n long, v string", part="day", kind="string", only=["2024-05-02"])
    assert plan.count() == 1 and len(plan.inputFiles()) == 1  # other days are not even listed
    with pytest.raises(Exception, match="no"):
        table.replace(days("bad").withColumn("v", F.raise_error("no").cast("string")), "day")
    assert table.read("n long, v string", part="day", kind="string").filter("v = 'bad'").count() == 0
    text = (tmp_path / "t" / "versions" / "1.json").read_text()
    assert set(json.loads(text)) == {"2024-05-01", "2024-05-02", "2024-05-03"}
