"""Cases that once took time or memory out of proportion."""

import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import common, decontaminate


def test_numbering_with_many_cells(spark):
    df = spark.range(100_000).select(F.lit("g").alias("g"), "id")
    began = time.time()
    out = common.numbered(df, ["g"], ["id"], "n", salts=100_000).agg(F.count_distinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    assert (out.d, out.lo, out.hi) == (100_000, 0, 99_999)
    assert time.time() - began < 30


def test_one_word_over_and_over_against_an_item_of_it():
    """20 000 equal words against an item of 20 000: a match for each start, not for each pair."""
    test = decontaminate.Test([("x", "x " * 20_000), ("y", "x " * 9)])
    tracemalloc.start()
    hashes, counts = decontaminate.Words().split(np.frombuffer(b"x " * 20_000, np.uint8), np.array([40_000]))
    rows = [np.concatenate(p) for p in zip(*decontaminate.Shard(hashes, counts, test).longest(), strict=True)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20
    got = {(i, p, s, n) for i, p, s, n in zip(*(x.tolist() for x in rows[1:]), strict=True) if i == 0}
    assert got == {(0, 0, s, 20_000 - s) for s in range(20_000 - 9)} | {(0, p, 0, 20_000 - p) for p in range(20_000 - 9)}


def test_stuttering_texts_through_spark(spark):
    docs = spark.createDataFrame([(1, "a " * 40_000 + "end"), (2, "b a a")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a " * 800 + "end"), ("j", "z")], "item_id string, text string")
    out = {r.doc_id: r for r in decontaminate.matches(docs, bench).withColumn("hit", decontaminate.n_hit(F.col("matches"))).collect()}
    assert out[1].hit == 40_001 and max(m.length for m in out[1].matches) == 801 and out[2].matches == []


def test_many_blocks_of_items_give_what_one_gives(spark):
    words = [f"w{k % 37} v{k % 11}" for k in range(3000)]
    text = " ".join(words)
    docs = spark.createDataFrame([(k % 30, " ".join(words[k * 20 : k * 20 + 60])) for k in range(60)] + [(None, text), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{k}", " ".join(words[k * 31 : k * 31 + 15])) for k in range(60)], "item_id string, text string")
    plain = lambda size: sorted((r.doc_id or -1, r.n_words, sorted(map(tuple, r.matches))) for r in decontaminate.matches(docs, bench, block_bytes=size).collect())
    assert plain(16 << 20) == plain(1500)
