"""Fast similarity sketching: its promises, and the operator against all pairs."""

import random
import re

import numpy as np

from tidewright.llm import sketch, substring

from test_llm import EDGES, empty, prose

LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w] if w else []))


def brute(rows):
    """(id, size, least reachable id, kept) of each row, from all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        low = min((x for x in groups[root(k)] if x is not None), default=None)
        out.append((i, len(sets[k]), low, i == low))
    return out


def edited(text, n, r):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_operator_against_all_pairs(spark, monkeypatch):
    r = random.Random(3)
    rows = list(EDGES)
    for k in range(12):  # families of copies with more and more edits, around the threshold and in chains
        base, at = prose(100 + k, r.choice([3, 6, 10, 40, 150, 600])), 0
        for _ in range(9):
            rows.append((1000 + len(rows), base))
            base = edited(base, max(1, len(base.split()) // r.choice([12, 20, 30])), r) if r.random() < 0.9 else base.upper()
    rows += [(5000 + k, "one") for k in range(40)] + [(6000, "ONE"), (6001, "one one"), (6002, "one one one"), (6003, None), (6004, "")]
    rows += [(7000 + k, edited(prose(9, 400), 4, r)) for k in range(120)]  # a dense group, in parts
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, component_id string")
    want = sorted(map(repr, brute(rows)))
    assert sorted(repr(tuple(x)) for x in sketch.near_duplicates(docs).collect()) == want
    monkeypatch.setattr(substring, "BLOCK", 16)
    assert sorted(repr(tuple(x)) for x in sketch.near_duplicates(docs).collect()) == want
    assert empty(sketch.near_duplicates(empty(docs))).count() == 0


def test_coordinates_agree_as_often_as_sets(spark):
    t, r = 175, np.random.default_rng(1)
    for n, shared in ((5, 4), (20, 16), (200, 160), (3000, 1500)):
        agree = []
        for _ in range(60):
            v = r.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
            both = sketch.sketches(np.concatenate([v[:n], v[n - shared :]]), np.array([n, n]), t)
            assert (both < np.uint64((1 << 64) - 1)).all()  # every coordinate is filled
            agree.append((both[0] == both[1]).mean())
        j = shared / (2 * n - shared)
        assert abs(np.mean(agree) - j) < 0.02 and np.std(agree) < 1.3 * (j * (1 - j) / t) ** 0.5


def test_a_set_has_one_sketch_whatever_stands_beside_it():
    r = np.random.default_rng(2)
    sizes = np.array([0, 1, 3, 0, 50, 2000])
    values = r.integers(0, 1 << 63, int(sizes.sum()), dtype=np.uint64)
    ends = np.cumsum(sizes)
    all_of = sketch.sketches(values, sizes, 64)
    for k, (e, n) in enumerate(zip(ends, sizes, strict=True)):
        assert (sketch.sketches(values[e - n : e], np.array([n]), 64)[0] == all_of[k]).all()


def test_bands_find_pairs_at_the_threshold():
    bands, rows = substring.tune_bands(sketch.THRESHOLD, sketch.RECALL, sketch.ROWS)
    assert (1 - 0.8**rows) ** bands <= 1e-6 < (1 - 0.8**rows) ** (bands - 1)


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(sketch.SQL)
    got = sketch.op11_sketch(spark, "/root/testdata/sf0.001").select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_sets_are_not_stored_between_rounds(spark, monkeypatch):
    stored, cut = [], substring.cut
    monkeypatch.setattr(substring, "cut", lambda df: stored.append(df.columns) or cut(df))
    docs = spark.createDataFrame([(k, prose(300 + k // 3, 60) + " end" * (k % 3)) for k in range(12)], "doc_id long, text string")
    assert {r.component_id for r in sketch.near_duplicates(docs).collect()} == {0, 3, 6, 9}
    assert stored and not [c for c in stored if "shingles" in c]
