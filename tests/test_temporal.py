"""As-of joins and bitemporal satellites against plain loops."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import bitemporal, pit

T0 = dt.datetime(2024, 5, 1)
at = lambda h: T0 + dt.timedelta(hours=h)
FACT, DIM = "item string, sold timestamp, n int, e string", "item string, price long, note string, effective_start timestamp, effective_end timestamp"


def as_of(facts, dims, inner=False):
    out = []
    for f in facts:
        best = [d for d in dims if d[0] == f[0] and f[0] is not None and f[1] is not None and d[3] <= f[1] and (d[4] is None or f[1] < d[4])]
        if best or not inner:
            out.append((*f, *(best[0][1:] if best else (None,) * 4)))
    return sorted(map(repr, out))


def history(r, item, n):
    times = sorted(r.sample(range(200), n))
    rows = []
    for a, b in zip(times, [*times[1:], None], strict=True):
        end = b if b is None or r.random() < 0.8 else r.randrange(a, b + 1)  # some versions end before the next one, some at once
        if b is None and r.random() < 0.5:
            end = a + 5
        rows.append((item, r.randrange(1000), None if r.random() < 0.2 else f"v{a}", at(a), None if end is None else at(end)))
    return rows


@pytest.mark.parametrize("hot_rows", [10**6, 60, 7])
def test_pit_join_against_a_plain_search(spark, hot_rows):
    r = random.Random(hot_rows)
    dims = [x for k in range(12) for x in history(r, f"i{k}", r.randrange(1, 9))] + history(r, "hot", 60)
    facts = [(r.choice(["hot", "hot", "i1", "i2", "i3", "none"]), at(r.randrange(210)), k, "x") for k in range(400)]
    facts += [(None, at(5), 1, "null key"), ("i1", None, 2, "null time"), ("hot", at(50), 7, "twice"), ("hot", at(50), 7, "twice")]
    facts += [(d[0], d[3], 0, "at its start") for d in dims] + [(d[0], d[4], 0, "at its end") for d in dims if d[4]]
    f, d = spark.createDataFrame(facts, FACT), spark.createDataFrame([*dims, (None, 1, "null key", at(0), None)], DIM)
    real = [x for x in dims if x[4] is None or x[4] > x[3]]
    got = pit.pit_join(f, d, ["item"], "sold", hot_rows=hot_rows)
    assert got.columns == ["item", "sold", "n", "e", "price", "note", "effective_start", "effective_end"]
    assert sorted(repr(tuple(x)) for x in got.collect()) == as_of(facts, real)
    inner = pit.pit_join(f, d, ["item"], "sold", how="inner", hot_rows=hot_rows)
    assert sorted(repr(tuple(x)) for x in inner.collect()) == as_of(facts, real, inner=True)
    assert pit.pit_join(f, d.filter("false"), ["item"], "sold").filter("price is not null").count() == 0
    assert pit.pit_join(f.filter("false"), d, ["item"], "sold").count() == 0


def test_one_hot_item_makes_no_pairs(spark):
    """10**5 facts and 10**4 versions of one item: the widest operator sees their sum, in several tasks."""
    f = spark.range(100_000).select(F.lit("hot").alias("item"), F.timestamp_seconds(F.col("id") * 7 % 1_000_000).alias("sold"))
    d = spark.range(10_000).select(F.lit("hot").alias("item"), "id", F.timestamp_seconds(F.col("id") * 100).alias("effective_start"), F.timestamp_seconds(F.col("id") * 100 + 100).alias("effective_end"))
    got = pit.pit_join(f, d, ["item"], "sold", hot_rows=10_000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any(">=" in line for line in plan.splitlines() if "Join" in line)
    wrong = got.filter((F.col("id") != F.floor(F.unix_timestamp("sold") / 100)) | F.col("id").isNull())
    assert got.count() == 100_000 and wrong.count() == 0
    hot = pit._hot_keys(f.select(F.col("item").alias("k0"), F.col("sold").alias("t")), d.select(F.col("item").alias("k0"), F.col("effective_start").alias("t")), ["k0"], 10_000).first()
    assert 8 <= len(hot.bounds) <= 11


KEYS, TRACKED, SAT = ["k"], ["v"], "k string, v string, ts timestamp"


def known(n):
    return F.lit(f"2024-06-{n:02d} 00:00:00").cast("timestamp")


def replay(spark, batches):
    table = None
    for n, b in enumerate(batches, 1):
        table = bitemporal.apply_batch(table, spark.createDataFrame(b, SAT), KEYS, TRACKED, "ts", known(n))
        table = spark.createDataFrame(table.collect(), table.schema)
    return table


def current(table, n=None):
    rows = bitemporal.known_at(table, None if n is None else known(n))
    return sorted(map(tuple, bitemporal.versions(rows, KEYS, TRACKED).collect()), key=repr)


def plain(batches):
    """The history of all changes, by a loop."""
    seen = {}
    for k, v, t in itertools.chain(*batches):
        seen.setdefault(k, {})[t] = v
    out = []
    for k, line in seen.items():
        cut = []
        for t in sorted(line):
            if not cut or cut[-1][1] != line[t]:
                cut.append((t, line[t]))
        for (t, v), nxt in zip(cut, [*cut[1:], None], strict=True):
            out.append((k, v, t, nxt and nxt[0], nxt is None))
    return sorted(out, key=repr)


def test_any_order_of_batches_gives_one_history(spark):
    batches = [[("a", "1", at(1)), ("b", "x", at(1)), ("a", "1", at(5))], [("a", "2", at(3)), ("c", None, at(2))], [("a", "3", at(9)), ("b", "x", at(0)), ("c", "z", at(4)), ("c", None, at(6))]]
    want = plain(batches)
    for order in itertools.permutations(batches):
        assert current(replay(spark, order)) == want
    assert ("a", "1", at(5), at(9), False) in want  # the value that returned after a late change


def test_what_was_known_when(spark):
    batches = [[("a", "1", at(1)), ("a", "3", at(9))], [("a", "2", at(4)), ("b", "x", at(1))], [("a", "2", at(4))], [("a", "0", at(0))]]
    table = replay(spark, batches)
    for n in range(1, 5):
        assert current(table, n) == plain(batches[:n]), n
    a = table.filter("k = 'a'")
    assert a.filter("known_from = timestamp'2024-06-03'").count() == 0  # a batch that comes again changes nothing
    # the late change closed one row and opened two; its neighbours stayed as they were
    second = a.filter("known_from = timestamp'2024-06-02'").count(), a.filter("known_to = timestamp'2024-06-02'").count()
    assert second == (2, 1) and table.filter("k = 'b'").count() == 1
    assert bitemporal.known_at(table, F.lit("2024-01-01").cast("timestamp")).count() == 0


def test_a_batch_meets_the_table_once_and_without_hashes(spark):
    """Rows are shuffled by their keys alone: none of the rows that a batch keeps, opens and closes is made from a shuffle of its own."""
    deals = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    first = bitemporal.apply_batch(None, spark.createDataFrame([("a", "1", at(1))], SAT), KEYS, TRACKED, "ts", known(1))
    assert len(deals(first)) == 1
    table = first.localCheckpoint()
    second = bitemporal.apply_batch(table, spark.createDataFrame([("a", "2", at(2)), ("b", "x", at(1))], SAT), KEYS, TRACKED, "ts", known(2))
    assert len(deals(second)) <= 7  # who is touched, twice a join with them, and the rows once
    without = bitemporal.apply_batch(table.drop("row_hash"), spark.createDataFrame([("a", "2", at(2)), ("b", "x", at(1))], SAT), KEYS, TRACKED, "ts", known(2))
    assert sorted(map(tuple, without.collect()), key=repr) == sorted(map(tuple, second.collect()), key=repr)
    assert len({r.row_hash for r in second.collect()}) == 3 and second.columns == first.columns


def test_ties_nulls_and_empty_batches(spark):
    one = replay(spark, [[("a", "x", at(1))], [("a", "y", at(1)), (None, "n", at(2)), ("a", "n", None)], []])
    other = replay(spark, [[("a", "y", at(1))], [("a", "x", at(1))]])
    assert len(current(one)) == 1 and current(one) == current(other)
    both = replay(spark, [[("a", "x", at(1)), ("a", "y", at(1)), ("a", "y", at(1))]])
    assert current(both) == current(one) and both.count() == 1
