"""SimHash near-duplicates, found by the pigeonring principle, and one document of each group of near copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substring
from .common import components, cut, fresh, slices, table

BITS, BOXES, BOX, MOST = 64, 4, 16, 3
#: Minima in a box of near-dedup's ring, and the share of pairs at the threshold that some chain must find.
PAIR, RECALL = 2, 0.999999
#: A-Z to a-z, every other byte as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints_of(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit fingerprints. A shingle's hash votes on each bit; over half sets it."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").translate(LOWER).split() if t else []
        if not words:
            continue
        if len(words) <= width:
            hashes = [digest(b" ".join(words), seed)]
        else:
            joined = memoryview(b" ".join(words))
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            starts = (ends - size)[: len(words) - width + 1].tolist()
            hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
        votes = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), 65536):  # long texts in parts, so that memory stays small
            h = np.array(hashes[k : k + 65536], "<u8")
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = (votes * 2 > len(hashes)).astype(np.uint8)
        out[i] = np.packbits(bits, bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with a fingerprint column ``name`` (long); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_column):
            fp = fingerprints_of(b.column(text_column).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` bigint")


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def _rotated(fp: Column, i: int) -> Column:
    """The ring turned so that box i comes first."""
    if not i:
        return fp
    return F.shiftleft(fp, i * BOX).bitwiseOR(F.shiftrightunsigned(fp, BITS - i * BOX))


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints of ``fps`` (fp: distinct longs) within MOST bits.

    Not every close pair is listed, but any two that are close are connected.

    1. Fingerprints within one bit of any common value are within two of each other. A value has
       at most 65 such neighbours, so each group is linked to its smallest member: all pairs
       within two bits are connected with a fixed number of rows per fingerprint, and a dense
       group of near copies becomes one class without its pairs.
    2. Pigeonring over a ring of four 16-bit boxes with a budget of 3: two fingerprints within
       three bits have a box from which every chain of l boxes differs in at most 3 * l / 4 bits:
       0, then 1, 2 and 3. The chain of two boxes is the join key (32 bits; the second box in its
       17 variants), the chain of three is checked next and the full distance last. Only pairs
       of different classes are looked at, and only classes are linked.
    """
    ball = F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(BITS)]))
    around = fps.select(ball.alias("x"), "fp")
    balls = around.groupBy("x").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    balls = cut(balls)
    pairs = balls.select(F.col("high").alias("a"), F.col("low").alias("b"))
    more = around.join(balls.filter("n > 2"), "x").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    close = cut(pairs.unionByName(more).filter("a <> b").distinct())
    classes = components(close)
    labelled = cut(fps.join(classes, fps["fp"] == classes["node"], "left").select("fp", F.coalesce("root", "fp").alias("c")))

    ring = F.array(*[F.struct(F.lit(i).alias("i"), _rotated(F.col("fp"), i).alias("r")) for i in range(BOXES)])
    turned = labelled.select("c", F.inline(ring))
    head = lambda r: F.shiftrightunsigned(r, 2 * BOX)
    start = F.shiftleft(F.col("i").cast("long"), 2 * BOX)
    index = turned.select((start + head(F.col("r"))).alias("key"), F.col("r").alias("q"), F.col("c").alias("cq"))
    variants = F.explode(F.array(head(F.col("r")), *[head(F.col("r")).bitwiseXOR(F.lit(1 << k)) for k in range(BOX)]))
    probe = turned.select("i", F.col("r").alias("p"), F.col("c").alias("cp"), variants.alias("v")).select((start + F.col("v")).alias("key"), "p", "cp")
    diff = F.col("p").bitwiseXOR(F.col("q"))
    chain = (F.bit_count(F.shiftrightunsigned(diff, BOX)) <= 3 * MOST // BOXES) & (F.bit_count(diff) <= MOST)
    found = probe.join(index, "key").filter((F.col("cp") < F.col("cq")) & chain)
    return close.unionByName(found.select(F.col("cq").alias("a"), F.col("cp").alias("b")).distinct())


def near_groups(fps: DataFrame) -> DataFrame:
    """Rows (fp, root) for all distinct fingerprints; a lone one is its own root."""
    groups = components(near_links(fps))
    return fps.join(groups, fps["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows share
    a fingerprint and each get a row; null ids are never the smallest unless a group has no
    other. Copies are one fingerprint, so a group of copies costs one row beyond the final join,
    whose hot key adaptive execution splits.
    """
    one = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    prints = cut(with_fingerprint(one, "fp").select("id", "fp"))
    fps = cut(prints.groupBy("fp").agg(F.min("id").alias("low")))
    groups = near_groups(fps.select("fp")).join(fps, "fp")
    ids = groups.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(groups.select("fp", "root").join(ids, "root").select("fp", "component_id"))
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_content(docs: DataFrame, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``name`` (long) that equal texts share: the hash of the words in a
    row, or of the stripped text where it is too short for a shingle; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = substring.Words()
        for b in slices(batches, text_column):
            t = substring.Text(b.column(text_column), words)
            key = t.prefix.run(t.first_word, t.first_word + t.counts)
            for i in np.flatnonzero(t.counts < substring.SHINGLE).tolist():
                key[i] = xxhash.xxh64_intdigest((b.column(text_column)[i].as_py() or "").encode("utf-8", "surrogatepass").strip())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.view(np.int64))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` bigint")


def tune_ring(threshold: float = substring.THRESHOLD, recall: float = RECALL) -> int:
    """The fewest boxes of PAIR = 2 minima of a ring on which ``recall`` of pairs at ``threshold`` share a
    chain of two boxes.

    A minimum differs with a probability of 1 - ``threshold``. A pair is missed if every box that
    agrees is followed by one that differs twice; the trace of a power of the steps from box to
    box is the probability of such rings.
    """
    j = threshold
    step = np.tile([j * j, 2 * j * (1 - j), (1 - j) ** 2], (3, 1))
    step[0, :2] = 0
    boxes = 2
    while np.trace(np.linalg.matrix_power(step, boxes)) > 1 - recall:
        boxes += 1
    return boxes


def ring_keys(minima: np.ndarray) -> np.ndarray:
    """The keys of each row's chains of two boxes; two rows share one if a chain of theirs is close.

    Pigeonring over boxes of PAIR minima with a budget of one difference less than boxes: two rows
    within it have a box from which every chain of l boxes differs in at most l - 1 minima, so the
    first box agrees and the next differs once at most. A key is thus the first box and one minimum
    of the next, two keys for each start.
    """
    n = minima.shape[1] // PAIR
    box = minima.reshape(len(minima), n, PAIR)
    after = np.roll(box, -1, axis=1)
    head = np.repeat(np.arange(n, dtype=np.uint64)[None, :], len(box), 0)
    with np.errstate(over="ignore"):
        for k in range(PAIR):
            head = substring._mix(head * substring._STEP + box[:, :, k])
        return np.concatenate([substring._mix((head + np.uint64(k + 1)) * substring._STEP + after[:, :, k]) for k in range(PAIR)], axis=1)


def ringed(docs: DataFrame, boxes: int) -> DataFrame:
    """h, bands: each whole text of five words or more by the hash of its words, and its ring keys. ``docs``: text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = substring.Words()
        for batch in slices(batches, "text"):
            t = substring.Text(batch.column("text"), words)
            a, b = t.wholes(substring.SHINGLE)
            keys = ring_keys(t.minima(a, b, boxes * PAIR))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * keys.shape[1], pa.int32()), substring._signed(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([substring._signed(t.prefix.run(a, b)), lists], names=["h", "bands"])

    return docs.select("text").mapInArrow(run, "h bigint, bands array<bigint>")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = substring.THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, one row a group, columns unchanged.

    A group is joined by chains of pairs with exact Jaccard >= ``threshold`` on five-word shingles
    of the whole texts. Candidates come from pigeonring chains of boxes, as for ``near_links``, but
    the ring is of minima, each of which differs in a fifth of pairs at the threshold: 64-bit fingerprints
    differ there by about 10 bits and by up to 19 at a like recall, which no boxes of theirs select.
    All pairs whose rings differ in fewer minima than boxes are candidates. What the ring misses, less
    than one pair at the threshold in a million, is found by prefixes of the full sets
    (``substring.all_links``), so no pair is left out. Texts of fewer than five words
    are grouped only if equal. If several rows of a group repeat its smallest id, one of them stays.
    """
    key = fresh(docs, "__content")
    marked = with_content(docs, key, text_column)
    small = cut(marked.select(F.col(key).alias("h"), F.col(id_column).alias("id")).groupBy("h").agg(F.min("id").alias("low")))
    none = F.lit(0).cast("long")
    src = docs.select(none.alias("doc"), none.alias("id"), docs[text_column].alias("text"))
    found = cut(ringed(src, tune_ring(threshold)))
    links = cut(substring.near_links(found, src, threshold, substring.SHINGLE, whole=True))
    classes = components(substring.all_links(links, src, threshold))
    groups = small.join(classes, small["h"] == classes["node"], "left").select("h", "low", F.coalesce("root", "h").alias("root"))
    # the smallest (has an id, id, content) of each group names the row that stays
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "h")).alias("m"))
    # one column of both, in which null ids are equal: texts are shuffled once for the join and the repeats
    row = fresh(docs, "__row")
    keep = cut(best.select(F.struct(F.col("m.h").alias("h"), F.col("m.low").alias("id")).alias(row)))
    named = marked.withColumn(row, F.struct(F.col(key).alias("h"), F.col(id_column).alias("id")))
    return named.join(keep, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
