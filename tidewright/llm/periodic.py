"""Periodic runs: stretches of words that repeat with one period, found online by their lags, and texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import slices, table, words_of

#: A run has at least this many words, and at least this many periods.
LEAST, COPIES = 6, 4
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


def runs_of(words: np.ndarray, counts: np.ndarray, least: int = LEAST, copies: int = COPIES) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run, by text, start and period.

    ``words``: word ids of all texts in a row; ``counts``: words of each text.

    The words are read from left to right. For each word its earlier occurrence at a lag adds one to
    the lag's match length; where a lag stops matching, its diagonal ends and is a run if it is long
    enough. Of all earlier occurrences only one a scale can count: at scale w = 1, 2, 4, ... the
    closest one of the last w words, if its lag is in (w/2, w]. For a run with smallest period q and
    w/2 < q <= w that occurrence is q away at every word from start + q + w - 1 to the last one (a
    closer one would, with q, give the run a smaller period), and nowhere else beside it (this needs
    three periods); so each
    scale has one active lag, its diagonal gives start and end exactly, and a multiple of a period
    is never active. So a text of n words costs n log n steps, of one repeated word too; words whose
    last w words stand nowhere else in their text leave before the next scale.
    """
    n_docs = len(counts)
    doc = np.repeat(np.arange(n_docs), counts)
    first = np.cumsum(counts) - counts
    at = np.flatnonzero(counts[doc] >= least) if len(doc) else np.zeros(0, np.int64)
    key = doc[at] * (int(words.max(initial=0)) + 1) + words[at]
    slot = np.full(len(doc), -1, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    width = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:]] = np.where(same, at[order[1:]] - at[order[:-1]], 0)
        # diagonals of this scale: a lag's match length grows from word to word until the lag changes
        hit = np.flatnonzero((lag > width // 2) & (lag <= width))
        if len(hit):
            place, q = at[hit], lag[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (place[1:] != place[:-1] + 1) | (q[1:] != q[:-1]) | (doc[place[1:]] != doc[place[:-1]])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(hit)) - 1
            q, start, end = q[head], place[head] - width + 1 - q[head], place[tail] + 1
            long = end - start >= np.maximum(least, copies * q)
            found.append((start[long], end[long], q[long]))
        # the next scale: twice as many words, only where both halves stand elsewhere too
        rank = np.zeros(len(at), np.int64)
        rank[order[1:]] = np.cumsum(~same)
        twin = np.zeros(len(at), bool)
        twin[order[1:]] |= same
        twin[order[:-1]] |= same
        twin &= counts[doc[at]] >= max(least, copies * (width + 1))
        kept = np.flatnonzero(twin)
        slot[at[kept]] = kept
        before = at[kept] - width
        ok = before >= first[doc[at[kept]]]
        left = np.where(ok, slot[np.maximum(before, 0)], -1)
        both = left >= 0
        slot[at[kept]] = -1
        key = rank[left[both]] * len(at) + rank[kept[both]]
        at = at[kept[both]]
        width *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    owner = doc[start]
    return owner, start - first[owner], end - start, period


def repeated(counts: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether each word lies in a run behind that run's first period."""
    step = np.zeros(int(counts.sum()) + 1, np.int64)
    base = (np.cumsum(counts) - counts)[owner] + start
    np.add.at(step, base + period, 1)
    np.add.at(step, base + length, -1)
    return np.cumsum(step[:-1]) > 0


def with_runs(docs: DataFrame, text_column: str = "text", runs: str = "runs", collapsed: str = "collapsed", least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """``docs`` plus ``runs`` (start, length, period in words, by start, then period) and ``collapsed``,
    the words outside all repeats joined by one space; no shuffle.

    A run is a stretch of words with smallest period q, of ``least`` words and ``copies`` periods at
    least, that no neighbouring word extends. A word is a repeat if any run contains it behind that
    run's first q words. Null and empty texts have no words, no runs and an empty ``collapsed``;
    repeated rows each get their result; the two names can be chosen where columns of ``docs`` clash
    with them, and a clash is an error. A text is held whole by one task, with some 60 bytes a word.
    """
    clash = {runs.lower(), collapsed.lower()} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first, or choose other names")
    if copies < 3:
        raise ValueError("a run must have three periods at least")
    schema = StructType(list(docs.schema.fields)).add(runs, ArrayType(RUN)).add(collapsed, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_column):
            # bytes.split() cuts at the six white-space characters of ASCII and at nothing else
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column(text_column).to_pylist()]
            counts = np.fromiter(map(len, texts), np.int64, len(texts))
            flat = pa.array([w for t in texts for w in t], pa.binary())
            owner, start, length, period = runs_of(flat.dictionary_encode().indices.to_numpy().astype(np.int64), counts, least, copies)
            keep = ~repeated(counts, owner, start, length, period)
            ends = np.cumsum(counts)
            touched = set(owner.tolist())
            lean = [b" ".join(t if i not in touched else [w for w, k in zip(t, keep[ends[i] - counts[i] : ends[i]].tolist(), strict=True) if k]) for i, t in enumerate(texts)]
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
            rows = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(lean, pa.binary()).cast(pa.string())], names=[*b.schema.names, runs, collapsed])

    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first. Null without runs."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, x: F.when(better(best, x), x).otherwise(best))


def stuttered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with repeats set into about every tenth text by a hash of its id: from word a on,
    the next p words over and over. Null ids and texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n = lambda w: F.size(w).cast("long")
    a = lambda w: F.pmod(g, F.greatest(n(w), F.lit(1)))
    p = lambda w: F.floor((n(w) - a(w)) / (F.pmod(g, F.lit(8)) + 3)).cast("long") + 1

    def again(bound: Column) -> Column:
        w, at, span = bound["w"], bound["a"], bound["p"]
        source = lambda i: F.when(i < at, i).otherwise(at + F.pmod(i - at, span))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n(w) - 1), lambda i: F.get(w, source(i).cast("int"))), " ")

    # values bound by a lambda are computed once a text and not once a word
    words = F.transform(F.array(words_of(F.col("text"))), lambda w: F.struct(w.alias("w"), a(w).alias("a"), p(w).alias("p")))
    text = F.get(F.transform(words, lambda b: F.when(n(b["w"]) > 0, again(b))), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(text, "text")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the strongest of them, and digests of all runs and of the collapsed text."""
    found = with_runs(stuttered(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
