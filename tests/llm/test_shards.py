"""Shards by whole texts."""

import random

from tidewright.llm import sharding

from test_llm import prose


def placed(spark, docs, n):
    out = sharding.shard(docs, n_shards=n).collect()
    text = {}
    for r in docs.select("doc_id", "text").collect():
        text.setdefault(r.doc_id, r.text)
    total, where = {}, {}
    for r in out:
        total[r.shard] = total.get(r.shard, 0) + r.size
        where.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert len(out) == docs.count()
    for k in total:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    return total, where


def test_copies_stay_together_whatever_their_metadata(spark):
    """Copies of other language and source, one text of a fifth of a shard, copies that exceed a shard, and no text."""
    r = random.Random(6)
    rows = [(k, "same" * 20, "en", f"s{k % 5}") for k in range(1500)] + [(2000, "L" * 20_000, "en", "a"), (2001, None, "en", "a"), (2002, "", "de", "b")]
    for k in range(700):
        text = prose(k, r.randrange(5, 12))
        rows += [(10_000 + len(rows) + i, text, r.choice(["en", "de", None]), f"s{r.randrange(9)}") for i in range(r.choice([1, 1, 2, 5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    total, where = placed(spark, docs, 4)
    mean = sum(total.values()) / 4
    assert max(abs(x - mean) for x in total.values()) <= 0.01 * mean and len(total) == 4
    assert 1500 * 96 > mean and 2 <= len(where.pop("same" * 20)) <= 4 and all(len(x) == 1 for x in where.values())


def test_a_sieve_is_small_lets_all_its_values_through_and_few_others(spark):
    import numpy as np

    from tidewright.llm.substring import Sieve

    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
    s = Sieve(spark.createDataFrame([(int(x),) for x in h[:10_000]], "v long"), "v")
    assert s.passes(h[:10_000]).all() and s.passes(h[10_000:]).mean() < 0.04
    assert s.size <= 16 * 10_000


def test_values_beyond_one_sieve_are_sifted_in_shares(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tidewright.llm import substring

    monkeypatch.setattr(substring, "MOST_SIEVE_BITS", 1 << 15)
    monkeypatch.setattr(substring, "PIECE_BITS", 1 << 13)
    h = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 30_000, dtype=np.int64)
    values = spark.createDataFrame([(int(x),) for x in h[:15_000]], "v long")
    rows = spark.createDataFrame([(int(x),) for x in h], "v long")
    sizes = []

    def scan(sieve):
        sizes.append((sieve.size, len(sieve.bits)))
        shared = sieve.sent(spark)
        assert sieve.bits is None  # the driver keeps none

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(shared.value.passes(b.column("v").to_numpy())))

        return rows.mapInArrow(run, "v long")

    got = [r.v for r in substring.sifted(values, "v", scan).collect()]
    assert len(sizes) == 4 and max(sizes) == (1 << 15, 1 << 12)  # 120 000 bits, 32 768 at once
    assert len(got) == len(set(got)) and set(h[:15_000].tolist()) <= set(got)  # each value by one share
    assert len(got) < 15_000 * 1.04
    assert len(sizes) and substring.sifted(rows.filter("false"), "v", scan).count() == 0


def test_repeated_passages_are_the_same_with_sieves_in_shares(spark, monkeypatch):
    import random

    from tidewright.llm import substring

    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    shared = [text(120) for _ in range(6)]
    docs = [(i, text(200) + " " + shared[i % 6] + " " + text(100) + "\n" + shared[(i + 1) % 6]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(map(tuple, substring.repeated_passages(df).collect()))
    monkeypatch.setattr(substring, "MOST_SIEVE_BITS", 1 << 8)
    asked, init = [], substring.Sieve.__init__
    monkeypatch.setattr(substring.Sieve, "__init__", lambda self, values, column, share=0, shares=1: asked.append(shares) or init(self, values, column, share, shares))
    assert sorted(map(tuple, substring.repeated_passages(df).collect())) == whole and whole
    assert max(asked) > 1
