"""Near duplicates by fast similarity sketching, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substring
from .common import components, cut, slices, table
from .decontaminate import Words, _bytes_of
from .substring import Sieve, _mix, _signed

WIDTH, THRESHOLD = 2, 0.8
#: Coordinates of a band, and the share of pairs at the threshold that some band must find.
ROWS, RECALL = 5, 0.999999

_ORD = np.arange(256)
#: Bytes of words in lower case, 0 for the six white-space characters; NUL, which may be in a word, takes the place of a capital.
LETTER = np.where((_ORD == 32) | ((_ORD >= 9) & (_ORD <= 13)), 0, np.where((_ORD >= 65) & (_ORD <= 90), _ORD + 32, np.where(_ORD == 0, 65, _ORD))).astype(np.uint8)
_ODD, _STEP, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64((1 << 64) - 1)


class Sets:
    """The distinct shingle hashes of each text of a batch, in a row: ``values``, ``sizes``, and one
    hash ``h`` of each set. A text of fewer words than ``width`` has its whole sequence as one."""

    def __init__(self, strings: pa.Array, words: Words, width: int = WIDTH):
        hashes, counts = words.split(*_bytes_of(strings))
        n = np.maximum(np.minimum(counts, 1), counts - width + 1)
        row = np.repeat(np.arange(len(counts)), n)
        at = (np.cumsum(counts) - counts)[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        short = np.minimum(counts, width)[row]
        value = short.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                here = hashes[np.minimum(at + k, len(hashes) - 1)] if len(hashes) else hashes
                value = np.where(k < short, _mix((value + here) * _ODD), value)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        self.values, self.row = value[new], row[new]
        self.sizes = np.bincount(self.row, minlength=len(counts)).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(self.values))])
        with np.errstate(over="ignore"):
            self.h = _mix(total[self.ends] - total[self.ends - self.sizes] + self.sizes.astype(np.uint64))


def sketches(values: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """A row of ``t`` coordinates for each set. Two sets agree in a coordinate with a probability of
    their Jaccard similarity, and the number of coordinates they agree in is concentrated.

    Round i throws every element of a set into one of t bins by the i-th hash function; a bin that
    is still empty keeps the least hash thrown into it, so an earlier round beats a later one. A set
    leaves once all its bins are full: after about t ln t throws, whatever its size. Rounds t to
    2t - 1 throw all elements into bin i - t, so that every coordinate is filled at the end.
    An empty set has only the greatest value.
    """
    n = len(sizes)
    out = np.full(n * t, _TOP)
    full = np.zeros(n * t, bool)
    row = np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        if not len(row):
            break
        with np.errstate(over="ignore"):
            v = _mix(values + _STEP * np.uint64(i + 1))
        bins = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(row), i - t)
        slot = row * t + bins
        empty = ~full[slot]
        np.minimum.at(out, slot[empty], v[empty])
        full[slot[empty]] = True
        done = np.ones(n, bool)
        present = np.unique(row)
        done[present] = full.reshape(n, t)[present].all(1)
        left = ~done[row]
        values, row = values[left], row[left]
    return out.reshape(n, t)


def sketched(docs: DataFrame, bands: int, rows: int, width: int = WIDTH) -> DataFrame:
    """id, h, n, bands: the hash and the size of each document's set, and one hash for each band of its
    sketch; equal sets have equal ones. ``docs``: id, text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(LETTER)
        for b in slices(batches, "text"):
            s = Sets(b.column("text"), words, width)
            h, one, which = np.unique(s.h, return_index=True, return_inverse=True)
            ends, sizes = s.ends[one], s.sizes[one]
            part = np.concatenate([s.values[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
            sk = sketches(part, sizes, bands * rows).reshape(len(one), bands, rows)
            key = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(one), 0)
            with np.errstate(over="ignore"):
                for k in range(rows):
                    key = _mix(key * _ODD + sk[:, :, k])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s.h) + 1) * bands, pa.int32()), _signed(key[which].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("id"), _signed(s.h), pa.array(s.sizes), lists], names=["id", "h", "n", "bands"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h bigint, n bigint, bands array<bigint>")


def sets_of(docs: DataFrame, sieve: Sieve, width: int = WIDTH) -> DataFrame:
    """h and the whole set of every document whose h passes the sieve."""
    shared = sieve.sent(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(LETTER)
        for b in slices(batches, "text"):
            s = Sets(b.column("text"), words, width)
            keep = shared.value.passes(s.h) & (s.sizes > 0)
            sizes = s.sizes[keep]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _signed(s.values[keep[s.row]]))
            yield pa.RecordBatch.from_arrays([_signed(s.h[keep]), lists], names=["h", "shingles"])

    return docs.mapInArrow(run, "h bigint, shingles array<bigint>")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable), kept.

    Documents are linked whose sets of ``width``-word shingles have a Jaccard similarity of
    ``threshold`` or more. Bands of a fast similarity sketch make candidates, so many that a pair at
    the threshold is missed with a probability of 1 - ``recall`` at most; every link is confirmed on
    the full sets (``substring.near_links``, which also splits large buckets). Documents with equal
    sets are one row from the start, so a group of copies costs a row each and no pairs.

    Null and empty texts have no set and are linked with nothing, nor with each other. Repeated rows
    each get a row; rows that repeat an id with other texts are documents of their own. Null ids are
    never the smallest unless a group has no other; kept then compares them as equal. An empty table
    gives no rows; other columns are ignored. Words and shingles are told apart by 64-bit hashes.
    """
    bands, rows = substring.tune_bands(threshold, recall, rows)
    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    found = cut(sketched(src, bands, rows, width))
    full = found.filter("n > 0")
    links = substring.near_links(full.select("h", "bands"), src, threshold, sets=lambda sieve: sets_of(src, sieve, width), main_first=True)
    classes = components(links)
    low = cut(full.groupBy("h").agg(F.min("id").alias("low")))
    groups = cut(low.join(classes, low["h"] == classes["node"], "left").select("h", "low", F.coalesce("root", "h").alias("root")))
    ids = cut(groups.groupBy("root").agg(F.min("low").alias("component_id")))
    named = cut(groups.select("h", "root").join(ids, "root").select("h", "component_id"))
    linked = full.select("id", "n", "h").join(named, "h").select("id", "n", "component_id")
    alone = found.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op11_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the query above: equal sets are one row, links by shared shingles, reachable ids by recursion.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) END AS sh FROM d
), u AS (
  SELECT sh, len(sh) AS n, min(doc_id) AS low, row_number() OVER (ORDER BY min(doc_id)) AS id FROM s WHERE len(sh) > 0 GROUP BY sh
), x AS (SELECT id, n, unnest(sh) AS g FROM u), p AS (
  SELECT a.id AS i, b.id AS j FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p), reach AS (
  SELECT id AS i, id AS j FROM u UNION SELECT reach.i, e.j FROM reach JOIN e ON reach.j = e.i
), c AS (SELECT i, min(low) AS low FROM reach JOIN u ON u.id = j GROUP BY i)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.low, s.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM coalesce(c.low, s.doc_id) AS kept
FROM s LEFT JOIN u USING (sh) LEFT JOIN c ON c.i = u.id
"""
