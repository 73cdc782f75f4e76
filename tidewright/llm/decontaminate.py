"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, slices, table

WINDOW = 10
#: Test items are searched in blocks of this many bytes; one block is what a task holds of them.
BLOCK_BYTES = 16 << 20
#: A longest verbatim match: words [start, start + length) of the document are words [item_start, ...) of the item.
MATCH = "struct<item:string,item_start:bigint,start:bigint,length:bigint>"

_ORD = np.arange(256)
#: Lower-cased bytes of words, 0 for separators: ASCII letters and digits, and all bytes of non-ASCII characters.
WORD_BYTE = np.where(((_ORD >= 48) & (_ORD <= 57)) | ((_ORD >= 97) & (_ORD <= 122)) | (_ORD >= 128), _ORD, np.where((_ORD >= 65) & (_ORD <= 90), _ORD + 32, 0)).astype(np.uint8)
#: A random odd number for each byte and an odd base: a word's hash is a polynomial modulo 2**64.
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words:
    """Word hashes of many texts at once, by array operations over their bytes. ``letters``: the byte
    that each byte of a word counts as, 0 for separators."""

    def __init__(self, letters: np.ndarray = WORD_BYTE) -> None:
        self.letters = letters
        self.power = self.inverse = np.ones(1, np.uint64)
        #: (first byte, end) of every word of the last split.
        self.bounds = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def split(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the words of each text. ``data``: the texts' bytes in a row."""
        n = len(data)
        if n >= len(self.power):
            size = 1 << (n + 1).bit_length()
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]))
                self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]))
        low = self.letters[data]
        inside = low != 0
        edge = (np.cumsum(sizes) - sizes)[sizes > 0]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[edge] = inside[edge]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edge[1:] - 1] = inside[edge[1:] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = (starts, ends)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_CODE[low] * self.power[:n], out=total[1:])
            hashes = (total[ends] - total[starts]) * self.inverse[starts]
            hashes ^= hashes >> np.uint64(29)
            hashes = hashes * _BASE + (ends - starts).astype(np.uint64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return hashes, np.diff(np.searchsorted(starts, bounds))


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = [b"" if t is None else t for t in strings.cast(pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(values), np.uint8), np.fromiter(map(len, values), np.int64, len(values))


class Test:
    """A block of items: their vocabulary, and the distinct heads of their suffixes (``window`` words,
    or a shorter item whole) with every (item, place) where such a suffix starts."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        data = [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
        hashes, counts = Words().split(np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data)))
        self.names, self.window = [i for i, _ in items], window
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        found: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        at, self.starts = 0, np.cumsum(counts) - counts
        self.counts, self.tokens = counts, ids
        for i, n in enumerate(counts.tolist()):
            words = ids[at : at + n].tolist()
            at += n
            for k in range(max(1, n - window + 1) if n else 0):
                found.setdefault(tuple(words[k : k + window]), []).append((words[k - 1] if k else 0, i, k))
        windows = sorted(found)
        self.length = np.fromiter(map(len, windows), np.int64, len(windows))
        self.words = np.zeros((len(windows), window), np.int64)
        for k, w in enumerate(windows):
            self.words[k, : len(w)] = w
        # owners of a window in order of the word before it, 0 where an item starts
        owners = [sorted(found[w]) for w in windows]
        self.owner_count = np.fromiter(map(len, owners), np.int64, len(owners))
        self.owner_start = np.cumsum(self.owner_count) - self.owner_count
        flat = np.array([x for o in owners for x in o], np.int64).reshape(-1, 3)
        self.owner, self.place = flat[:, 1], flat[:, 2]
        self.span = len(self.vocabulary) + 2
        self.owner_key = np.repeat(np.arange(len(windows)), self.owner_count) * self.span + flat[:, 0]


class Runs:
    """Hashes of token runs from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        with np.errstate(over="ignore"):
            code = (tokens.astype(np.uint64) + np.uint64(1)) * _CODE[0]
            code = (code ^ (code >> np.uint64(31))) * _CODE[1]
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
            self.total = np.concatenate([[np.uint64(0)], np.cumsum((code ^ (code >> np.uint64(29))) * power[:n])])

    def run(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[start + length] - self.total[start]) * self.inverse[start]


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all non-zero tokens, sorted by their next ``depth`` tokens; 0 ends a text or is a word no item has.

    Prefix doubling: ranks by h tokens give ranks by 2h. ``tokens`` ends with ``depth`` zeros at least.
    """
    at = np.flatnonzero(tokens)
    rank = tokens.astype(np.int64)
    h = 1
    while h < depth:
        key = rank[at] * (int(rank.max(initial=0)) + 1) + rank[np.minimum(at + h, len(rank) - 1)]
        _, inverse = np.unique(key, return_inverse=True)
        rank[at] = inverse + 1
        h *= 2
    return at[np.argsort(rank[at], kind="stable")]


def interval(tokens: np.ndarray, array: np.ndarray, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``words`` (its first ``length`` tokens) the range of ``array`` that starts with it."""
    width = np.arange(words.shape[1])
    used = width[None, :] < length[:, None]

    def bound(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), len(array), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            near = tokens[array[np.minimum(mid, len(array) - 1)][:, None] + width]
            diff = np.where(used, near - words, 0)
            k = (diff != 0).argmax(1)
            d = diff[np.arange(len(diff)), k]
            go = open_ & ((d <= 0) if right else (d < 0))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    return (bound(False), bound(True)) if len(array) else (np.zeros(len(words), np.int64),) * 2


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for ``count`` values, for all pairs in a row."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Pairs of places that are looked at together.
PAIRS = 1 << 20


class Shard:
    """A run of documents as tokens: ids of the words that items have, 0 for others and after each document."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, test: Test):
        n_docs = len(counts)
        self.counts, self.test = counts, test
        doc = np.repeat(np.arange(n_docs), counts)
        where = np.searchsorted(test.vocabulary, hashes)
        known = test.vocabulary[np.minimum(where, len(test.vocabulary) - 1)] == hashes if len(test.vocabulary) else np.zeros(len(hashes), bool)
        self.tokens = np.zeros(len(hashes) + n_docs + 2 * test.window + 16, np.int64)
        self.tokens[np.arange(len(hashes)) + doc] = np.where(known, where + 1, 0)
        self.first = np.cumsum(counts) - counts + np.arange(n_docs)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(token, window) wherever a suffix head of the test occurs, by suffix array and binary search."""
        if not len(self.test.words) or not self.tokens.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        array = suffix_array(self.tokens, self.test.window)
        lo, hi = interval(self.tokens, array, self.test.words, self.test.length)
        return array[_ranges(lo, hi - lo)], np.repeat(np.arange(len(lo)), hi - lo)

    def longest(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Longest matches in portions: (document, item, place in the item, first word, words).

        Where a head occurs, a longest match with an item's place starts if the words before the two
        differ or one of them is the first; owners of a head lie in order of that word, so only such
        pairs are ever made, one for each match, however often a text or an item repeats a word. How
        far a match goes is found by halving over hashes of runs."""
        test = self.test
        at, window = self.occurrences()
        if not len(at):
            return
        before = np.where(at > 0, self.tokens[np.maximum(at - 1, 0)], 0)
        lo, n = test.owner_start[window], test.owner_count[window]
        key = window * test.span + before
        a = np.where(before > 0, np.searchsorted(test.owner_key, key), lo + n)
        b = np.where(before > 0, np.searchsorted(test.owner_key, key, "right"), lo + n)
        head, tail = a - lo, lo + n - b
        here, there = Runs(self.tokens), Runs(test.tokens)
        ends = np.cumsum(head + tail)
        k = 0
        while k < len(at):
            base = int(ends[k - 1]) if k else 0
            e = max(k + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            part = slice(k, e)
            pick = np.concatenate([_ranges(lo[part], head[part]), _ranges(b[part], tail[part])])
            start = np.concatenate([np.repeat(at[part], head[part]), np.repeat(at[part], tail[part])])
            least = np.concatenate([np.repeat(test.length[window[part]], head[part]), np.repeat(test.length[window[part]], tail[part])])
            k = e
            item, place = test.owner[pick], test.place[pick]
            doc = np.searchsorted(self.first, start, "right") - 1
            word = start - self.first[doc]
            other = test.starts[item] + place
            most = np.minimum(self.counts[doc] - word, test.counts[item] - place)
            while (go := least < most).any():
                mid = np.where(go, (least + most + 1) // 2, least)
                same = here.run(start, mid) == there.run(other, mid)
                least, most = np.where(go & same, mid, least), np.where(go & ~same, mid - 1, most)
            yield doc, item, place, word, least


def search(docs: DataFrame, test: Test, text_column: str, n_words: str, found: str) -> DataFrame:
    """Fill the columns ``n_words`` and ``found`` with what one block of items finds; narrow, documents keep their rows."""
    shared = docs.sparkSession.sparkContext.broadcast(test)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, split = shared.value, Words()
        items = pa.array(test.names, pa.string())
        for b in slices(batches, text_column, 2 << 20):
            hashes, counts = split.split(*_bytes_of(b.column(text_column)))
            parts = list(Shard(hashes, counts, test).longest())
            doc, item, place, word, length = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5
            order = np.argsort(doc, kind="stable")
            offsets = np.searchsorted(doc[order], np.arange(len(counts) + 1))
            rows = pa.StructArray.from_arrays([items.take(pa.array(item[order])), *(pa.array(x[order]) for x in (place, word, length))], names=["item", "item_start", "start", "length"])
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            cols |= {n_words: pa.array(counts), found: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def blocks(bench: DataFrame, item_column: str = "item_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[Test]:
    """The test set in blocks of a checked size: what any task or the driver holds of it at once."""
    items = bench.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("i"), F.col(text_column).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(1.5 * total / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield Test([(r["i"], r["t"]) for r in part.collect()], window)


def matches(docs: DataFrame, bench: DataFrame, text_column: str = "text", block_bytes: int = BLOCK_BYTES, n_words: str = "n_words", found: str = "matches") -> DataFrame:
    """``docs`` plus the columns ``n_words`` and ``matches``: the longest verbatim matches of ten words
    or more (or of a shorter item, whole) with items: item, item_start, start, length, in words.

    A shard is a run of documents of about 2 MB in one task; its suffix array over word ids is
    sorted by prefix doubling. Every test suffix is binary-searched in it by its first ten
    words, the least that counts; from there each longest match is made once. A test set of one
    block takes one narrow pass; of a larger one, each further block takes a pass that writes the
    matches of each different text to the checkpoint folder, the text known by two hashes, and one
    join brings them to the documents. Words are told apart by a 64-bit hash.

    Null and empty texts have no words; an empty test set finds nothing; copies of a passage are
    found in every document; repeated rows each get their result. The two names can be chosen
    where columns of ``docs`` clash with them; a clash is an error.
    """
    clash = {n_words.lower(), found.lower()} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first, or choose other names")
    none = F.array().cast(f"array<{MATCH}>")
    blank = lambda df: df.withColumns({n_words: F.lit(0).cast("bigint"), found: none})
    state, more = None, []
    keys = [fresh(docs, "__h1"), fresh(docs, "__h2")]
    text = F.col(text_column)
    key = [F.xxhash64(text).alias(keys[0]), F.hash(text, F.octet_length(text)).alias(keys[1])]
    for test in blocks(bench, text_column="text", block_bytes=block_bytes):
        if state is None:
            state = search(blank(docs), test, text_column, n_words, found)
        else:
            hits = search(blank(docs.select(*key, text_column)), test, text_column, n_words, found)
            more.append(cut(hits.filter(F.size(found) > 0).select(*keys, found).dropDuplicates(keys)))
    if not more:
        return state
    extra, other = more[0], fresh(state, "__found")
    for x in more[1:]:
        extra = extra.unionByName(x)
    extra = cut(extra.groupBy(*keys).agg(F.flatten(F.collect_list(found)).alias(other)))
    joined = state.withColumns(dict(zip(keys, key, strict=True))).join(extra, keys, "left")
    return joined.select(*docs.columns, n_words, F.concat(found, F.coalesce(other, none)).alias(found))


def n_hit(found: Column) -> Column:
    """Words inside any match: matches in order of their start, each counted from where the last ended."""
    ends = F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(x["a"], acc["at"]))).alias("n"), F.greatest(acc["at"], x["b"]).alias("at"))
    return F.aggregate(ends, zero, step, lambda acc: acc["n"])


def remove_contaminated(docs: DataFrame, bench: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without a word inside a test window, columns unchanged (any names)."""
    inner, text = fresh(docs, "__row"), fresh(docs, "__text")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(inner), F.col(text_column).alias(text))
    return matches(packed, bench, text).filter(F.size("matches") == 0).select(f"{inner}.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark"))
    hit = n_hit(F.col("matches"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"), longest.alias("longest_match"),
    )


#: DuckDB SQL for the query above, window by window.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g, k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), hit AS (
  SELECT dw.r, dw.i, dw.n, bw.item_id, bw.k FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), runs AS (
  SELECT r, max(n) + count(*) - 1 AS m FROM (SELECT DISTINCT *, i - row_number() OVER (PARTITION BY r, item_id, i - k ORDER BY i) AS s FROM (SELECT DISTINCT * FROM hit)) GROUP BY r, item_id, i - k, s
), n AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
), l AS (SELECT r, max(m) AS m FROM runs GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(m, 0)::BIGINT AS longest_match
FROM d LEFT JOIN n USING (r) LEFT JOIN its USING (r) LEFT JOIN l USING (r)
"""
