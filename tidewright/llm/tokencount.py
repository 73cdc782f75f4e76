"""Unigram token counts from a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: A pre-token is a run of anything but ASCII white space; the marker stands for the space before it.
MARK = "▁"


def load_vocabulary(path: str) -> dict[str, float]:
    """Pieces of a public sentencepiece file with unigram scores.

    The file lists pieces by rank without probabilities, so a piece of rank r gets Zipf's
    log(1 / (r + 1)). Control and byte pieces are left out.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        sp.id_to_piece(i): -math.log(i + 1.0)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
    }


class Trie:
    """Distinct pre-tokens; each node keeps the best score and token count of its prefix.

    Pre-tokens that share a prefix share its nodes, so the dynamic programme runs once per
    distinct prefix. The terminal count of a pre-token is the count at its last node. A character
    no piece covers is spelt in bytes: one token a byte at ``byte_score`` each. Ties take fewer
    tokens, so results do not depend on insertion order. Beyond ``max_nodes`` the trie starts
    anew, which bounds memory and changes no result.
    """

    def __init__(self, scores: dict[str, float], max_nodes: int = 1_500_000):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def total(self, words: list[bytes]) -> int:
        """Tokens of all words (UTF-8)."""
        known = list(map(self.terminal.get, words))
        if None in known:
            known = [self.tokens(w) if n is None else n for w, n in zip(words, known, strict=True)]
        return sum(known)

    def tokens(self, raw: bytes) -> int:
        known = self.terminal.get(raw)
        if known is not None:
            return known
        word = raw.decode("utf-8", "surrogatepass")
        if len(self.score) > self.max_nodes or len(self.terminal) > self.max_nodes:
            self.clear()
        w = MARK + word
        if len(w) > 512:  # one very long pre-token would fill the trie; nothing shares its tail
            return self._straight(w)
        child, score, count = self.child, self.score, self.count
        node, best, n = 0, [0.0], [0]  # best score and count of every prefix of this word
        for d, c in enumerate(w):
            key = node << 21 | ord(c)
            nxt = child.get(key)
            if nxt is None:
                s, k = self._step(w, d + 1, best, n)
                nxt = child[key] = len(score)
                score.append(s)
                count.append(k)
            node = nxt
            best.append(score[node])
            n.append(count[node])
        self.terminal[raw] = count[node]
        return count[node]

    def _step(self, w: str, d: int, score: list[float], count: list[int]) -> tuple[float, int]:
        """Best (score, count) of the prefix of ``d`` characters from those of the shorter ones."""
        scores = self.scores
        best, n = None, 0
        for i in range(max(0, d - self.longest), d):
            piece = w[i:d]
            if piece in scores:
                s = scores[piece] + score[i]
                if best is None or s > best or (s == best and count[i] + 1 < n):
                    best, n = s, count[i] + 1
        size = len(w[d - 1].encode("utf-8", "surrogatepass"))
        spelt = score[-1] + size * self.byte_score
        if best is None or spelt > best or (spelt == best and count[-1] + size < n):
            return spelt, count[-1] + size
        return best, n

    def _straight(self, w: str) -> int:
        score, count = [0.0], [0]
        for d in range(1, len(w) + 1):
            best, n = self._step(w, d, score, count)
            score.append(best)
            count.append(n)
        return count[-1]


_TRIES: list[tuple[dict[str, float], Trie]] = []


def _trie(scores: dict[str, float]) -> Trie:
    """One per Python worker and vocabulary, so that prefixes stay known from task to task."""
    if not _TRIES or _TRIES[0][0] is not scores:
        _TRIES[:] = [(scores, Trie(scores))]
    return _TRIES[0][1]


def count_tokens(docs: DataFrame, vocabulary: dict[str, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: its id, ``n_pretokens`` and ``n_tokens`` under the unigram scores.

    Narrow: every worker keeps a trie of the pre-tokens it has met, so no word is shuffled. The
    vocabulary is a fixed file, sent once to each executor; its size is checked. Null and empty
    texts have no tokens; repeated rows each get their row; other columns are not read.
    """
    if len(vocabulary) > 2_000_000:
        raise ValueError("the vocabulary is too large to send to every executor")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared.value)
        for b in slices(batches, "text"):
            n_pre, n_tok = [], []
            for t in b.column("text").to_pylist():
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                n_pre.append(len(words))
                n_tok.append(trie.total(words))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(n_pre, np.int64)), pa.array(np.array(n_tok, np.int64))], names=["id", "n_pretokens", "n_tokens"])

    src = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_column)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the pieces of the public 32k vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
