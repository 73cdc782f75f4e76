"""Best-fit packing of tokenised documents under several capacities."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered, slices, table

#: White space to a text splitter but not to the tokenizer; texts that hold one go the long way.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
END = " "  # stands for the end of a document; white space is never a word


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold. ``attention`` bounds the sum of squared piece lengths.

    The defaults of ``docs`` and ``attention`` are the largest values that ``tokens`` allows, so
    that they cost no sequence; smaller ones are honoured alike. ``score``: ``dot`` prefers the
    bin whose residual vector has the smallest dot product with ``weights`` and the item's
    demand, ``norm`` the one whose residual after placing has the smallest weighted norm.
    """

    tokens: int = 4096
    docs: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"


_LETTERS = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
#: After lower-casing: runs of Latin letters, and runs of anything else but white space.
RUNS = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}\\s]+")
LETTERS = re.compile(f"[{_LETTERS}]+")
#: A text with one of these is split at white space only: letters that are not Latin, marks that
#: join letters, the apostrophe of contractions, and the start of a special token.
NOT_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x26\\x28-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]|<\\|")


class WordTokenizer:
    """Token ids by words: each distinct word is encoded once.

    The tokenizer lower-cases, splits at white space and parts letters from all else, so a text
    of Latin letters is the sequence of its runs, and any text that of its white-space words.
    Runs of letters not met before are encoded together in one call: each ends in exactly one
    end-of-word token, which tells them apart again. Holds at most ``max_words`` words, then
    starts anew; results never depend on it.
    """

    def __init__(self, definition: str, end_id: int, max_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(definition)
        self.end_id, self.max_words = end_id, max_words
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        if not suffix:
            raise ValueError("the tokenizer must mark the ends of words")
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.index = {END: 0}
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([self.end_id], np.uint32)

    def words(self, text: str) -> list[str]:
        if not NOT_PLAIN.search(text):
            return RUNS.findall(text.lower())
        # white space to Python, but not to the tokenizer, which then splits the text itself
        return [text] if any(c in text for c in ODD_SPACE) else text.split()

    def learn(self, new: list[str]) -> None:
        plain = [w for w in new if LETTERS.fullmatch(w)]
        odd = [w for w in new if not LETTERS.fullmatch(w)]
        ids = np.array(self.tok.encode(" ".join(plain), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(plain):
            raise AssertionError("a run of letters must end in one end-of-word token")
        rest = [e.ids for e in self.tok.encode_batch(odd, add_special_tokens=False)]
        size = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])
        flat = np.concatenate([ids, np.fromiter((i for x in rest for i in x), np.uint32)])
        self.index.update(zip([*plain, *odd], range(len(self.index), len(self.index) + len(new)), strict=True))
        self.start = np.concatenate([self.start, np.cumsum(size) - size + len(self.flat)])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text closed by the end id; and the ids of each text."""
        words: list[str] = []
        n_words = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                words += self.words(t)
            words.append(END)
            n_words[i] = len(words)
        if len(self.index) > self.max_words:
            self.clear()
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lacking = [words[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(lacking)))
            at[missing] = np.fromiter(map(self.index.__getitem__, lacking), np.int64, len(lacking))
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(ends[n_words - 1], prepend=0)


@lru_cache(maxsize=1)
def _tokenizer(definition: str, end_id: int) -> WordTokenizer:
    """One per Python worker, so that words stay known from task to task."""
    return WordTokenizer(definition, end_id)


def pieces(docs: DataFrame, definition: str, capacity: Capacity, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents as runs of at most ``capacity.tokens`` ids: doc_id, piece, start, length, ids_crc32."""
    shared = docs.sparkSession.sparkContext.broadcast((definition, end_id, capacity.tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        definition, end_id, most = shared.value
        tok = _tokenizer(definition, end_id)
        for b in slices(batches, "text", 1 << 20):
            ids, sizes = tok.encode(b.column("text").to_pylist())
            n = -(-sizes // most)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * most
            length = np.minimum(sizes[row] - start, most)
            first = (np.cumsum(sizes) - sizes)[row] + start
            crc = np.fromiter((zlib.crc32(ids[a:e]) for a, e in zip(first.tolist(), (first + length).tolist(), strict=True)), np.int64, len(row))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return out.withColumnRenamed("id", "doc_id")


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Vector best fit, longest pieces first, over counts of piece lengths.

    A piece's whole demand (tokens, one document, squared length) follows from its length, so
    bins that hold equal loads are interchangeable and are kept as one state with a count. Every
    length opens at most a few states, so the plan has a few rows per length at any corpus size.
    Rows: (length, first rank, sequence of that rank, pieces per sequence, offset of the first).
    """
    cap = np.array([capacity.tokens, capacity.docs, capacity.attention], float)
    w = np.array(capacity.weights)
    states: list[list[int]] = []  # tokens left, docs left, attention left, first bin, bins
    rows, n_bins = [], 0

    def fits(state: list[int], size: int) -> int:
        return min(state[0] // size, state[1], state[2] // (size * size))

    for size in sorted(histogram, reverse=True):
        if size > capacity.tokens or size * size > capacity.attention or capacity.docs < 1:
            raise ValueError(f"a piece of {size} tokens fits no sequence")
        left, rank = histogram[size], 0
        demand = np.array([size, 1, size * size], float) / cap
        arr = np.array([s[:3] for s in states], float).reshape(-1, 3)
        can = (arr[:, 0] >= size) & (arr[:, 1] >= 1) & (arr[:, 2] >= size * size)
        res = arr / cap
        value = (res * demand * w).sum(1) if capacity.score == "dot" else ((res - demand) ** 2 * w).sum(1)
        order = [i for i in np.argsort(value, kind="stable") if can[i]]
        spare: list[list[int]] = []
        for i in order:
            if not left:
                break
            tokens, docs, att, first, bins = states[i]
            each = fits(states[i], size)
            full = min(bins, left // each)
            some = left - full * each if full < bins else 0
            for count, per in ((full, each), (1, some)):
                if count and per:
                    rows.append((size, rank, first, per, capacity.tokens - tokens))
                    spare.append([tokens - per * size, docs - per, att - per * size * size, first, count])
                    first, bins, rank, left = first + count, bins - count, rank + count * per, left - count * per
            states[i] = [tokens, docs, att, first, bins]
        if left:
            each = fits([capacity.tokens, capacity.docs, capacity.attention], size)
            full, some = divmod(left, each)
            for count, per in ((full, each), (1, some)):
                if count and per:
                    rows.append((size, rank, n_bins, per, 0))
                    spare.append([capacity.tokens - per * size, capacity.docs - per, capacity.attention - per * size * size, n_bins, count])
                    n_bins, rank = n_bins + count, rank + count * per
        states = [s for s in states + spare if s[4] and s[0] and s[1] and s[2]]
    return rows


def pack(cut_pieces: DataFrame, capacity: Capacity) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``pieces``.

    The driver sees one count per length (at most ``capacity.tokens`` of them). Pieces of a
    length are numbered in salted cells, and each rank looks up its place in the plan.
    """
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, capacity)
    span = 1 << 44  # ranks of one length stay below it
    key = np.array([s[0] * span + s[1] for s in steps], np.int64)
    order = np.argsort(key)
    arrays = (key[order], *(np.array([s[k] for s in steps], np.int64)[order] for k in range(5)))
    shared = spark.sparkContext.broadcast(arrays)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, _, rank0, first, per, offset = shared.value
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            i = np.searchsorted(key, size * span + rank, "right") - 1
            bin_no, nth = np.divmod(rank - rank0[i], per[i])
            cols = [b.column(c) for c in b.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first[i] + bin_no), pa.array(offset[i] + nth * size)], names=[*(c for c in b.schema.names if c != "__rank"), "sequence_id", "offset"])

    ranked = numbered(cut_pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "__rank").select(*cut_pieces.columns, "__rank")
    schema = ", ".join(f"{n} {t}" for n, t in cut_pieces.dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: Capacity = Capacity(), end_id: int = 1) -> DataFrame:
    """Cut, tokenise and pack all documents.

    Null and empty texts are the end id alone; repeated rows are packed once each; other columns
    are ignored. The piece table (no text, no ids) is written once to the checkpoint folder.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    return pack(cut(pieces(docs, definition, capacity, end_id)), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
