"""Periodic runs against a plain search over all lags."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewright.llm import periodic

from test_llm import EDGES, empty

HAND = ["a b a b a b a b", "x " * 5, "x " * 6, "a b c a b c a b c a b c a", "p q p q p q p q r r r r r r r s", "u v u v u v u v w u v u v u v u v", "a a b a a b a a b a a b a a a a a a", "\x1ca \x1ca \x1ca \x1ca \x1ca \x1ca"]


def brute(words):
    """(start, length, period) of all runs, lag by lag; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words)):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def altered(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(words):
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    lean = b" ".join(x for i, x in enumerate(words) if i not in drop)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(lean).hexdigest())


def test_query_against_all_lags(spark, tmp_path):
    r = random.Random(5)
    rows = list(EDGES) + [(100 + i, t) for i, t in enumerate(HAND)]
    for i in range(400):
        words = [r.choice("abcde"[: r.choice([2, 3, 5])]) for _ in range(r.randrange(80))]
        if words and r.random() < 0.5:  # a period from some word on, here and there with a fault
            a, p = r.randrange(len(words)), r.randrange(1, 9)
            words = [w if k < a + p or r.random() < 0.02 else words[a + (k - a) % p] for k, w in enumerate(words)]
        rows.append((1000 + i, r.choice([" ", "\n"]).join(words)))
    spark.createDataFrame([(i, t, "en", "x") for i, t in rows], "doc_id long, text string, Runs string, best string").write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic.op13_periodic_runs(spark, str(tmp_path)).collect()
    got = sorted(repr(tuple(x)) for x in out)
    assert got == sorted(repr((i, *expected(altered(i, t)))) for i, t in rows)
    assert sum(x.n_runs > 0 for x in out) > 100 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_names_empty_tables_and_one_repeated_word(spark):
    docs = spark.createDataFrame([(1, "x " * 50_000 + "y", 7)], "doc_id long, text string, runs int")
    with pytest.raises(ValueError, match="rename"):
        periodic.with_runs(docs)
    row = periodic.with_runs(docs, runs="found").first()
    assert row.found == [(0, 50_000, 1)] and row.collapsed == "x y" and row.runs == 7
    assert empty(periodic.with_runs(empty(docs), runs="found")).count() == 0


def test_other_limits(spark):
    docs = spark.createDataFrame([(1, "a b a b a b c c c")], "doc_id long, text string")
    row = periodic.with_runs(docs, least=3, copies=3).select(F.col("runs").alias("r")).first()
    assert [tuple(x) for x in row.r] == [(0, 6, 2), (6, 3, 1)]
    with pytest.raises(ValueError, match="three"):
        periodic.with_runs(docs, copies=2).count()
