"""Shards of near-equal bytes: a k-d tree cut at distributed weighted medians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import cut, numbered, table

#: Cells of one search pass. Boxes of a level up to BROADCAST_BOXES (about 100 bytes each) are sent to every task.
CELLS, BROADCAST_BOXES = 1 << 16, 20_000
#: A level whose boxes have no more rows each (some 60 bytes a row) is cut by sorting every box in one task.
SORT_ROWS = 1_000_000
LEAST = -(1 << 63)
#: Depth of a cut's key: the dimension, then the tie, then the row.
KEYS = ("value", "tie", "row")


def _with_boxes(rows: DataFrame, boxes: DataFrame, n_boxes: int) -> DataFrame:
    return rows.join(F.broadcast(boxes) if n_boxes <= BROADCAST_BOXES else boxes, "box")


def _value(dims: list[str]) -> Column:
    out = F.col(dims[0])
    for i, d in enumerate(dims[1:], 1):
        out = F.when(F.col("dim") == i, F.col(d)).otherwise(out)
    return out


def _open_boxes(rows: DataFrame, dims: list[str], shards: DataFrame, width: dict[str, int]) -> DataFrame:
    """What a search needs of each box with more than one shard: its widest dimension (its range over
    the whole table's), the range there, and the bytes that go left."""
    spans = rows.groupBy("box").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    ranges = [F.struct(((F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.lit(width[d])).alias("share"), F.lit(-i).alias("dim"), F.col(f"lo_{d}").alias("low"), F.col(f"hi_{d}").alias("high")) for i, d in enumerate(dims)]
    widest = F.array_max(F.array(*ranges))
    df = shards.filter("shards > 1").join(spans.withColumn("widest", widest), "box")
    half = F.floor(F.col("shards") / 2)
    return df.select(
        "box", "shards", "first", "rows", (-F.col("widest.dim")).alias("dim"), F.lit(0).alias("phase"), F.col("widest.low").alias("low"), F.col("widest.high").alias("high"),
        F.lit(0).cast("long").alias("before"), (F.col("w") * half / F.col("shards")).alias("goal"), *[F.lit(LEAST).alias(f"at_{k}") for k in KEYS], F.lit(False).alias("found"),
    )


def _narrow(rows: DataFrame, boxes: DataFrame, n_boxes: int, dims: list[str]) -> DataFrame:
    """One pass: the search interval of every box shrinks to the cell that holds its goal.

    ``at_value``, ``at_tie`` and ``at_row`` hold what is fixed so far, and the cut once ``found``.
    Cells are summed with map-side aggregation; at most CELLS sums of one box meet in a task.
    """
    c = F.col
    todo = boxes.filter("not found")
    near = _with_boxes(rows, todo, n_boxes).withColumn("value", _value(dims))
    fixed = ((c("phase") < 1) | (c("value") == c("at_value"))) & ((c("phase") < 2) | (c("tie") == c("at_tie")))
    key = F.when(c("phase") == 0, c("value")).when(c("phase") == 1, c("tie")).otherwise(c("row"))
    near = near.withColumn("key", key).filter(fixed & c("key").between(c("low"), c("high")))
    # a distance between two hashes may exceed a long; close ones need its exactness
    width = c("high").cast("double") - c("low").cast("double")
    away = F.when(width < float(1 << 62), (c("key") - c("low")).cast("double")).otherwise(c("key").cast("double") - c("low").cast("double"))
    share = away * F.lit(CELLS) / (F.when(width < float(1 << 62), (c("high") - c("low")).cast("double")).otherwise(width) + 1)
    cell = F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    cells = near.groupBy("box", cell.alias("cell")).agg(F.sum("size").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    upto = F.sum("w").over(Window.partitionBy("box").orderBy("cell"))
    hit = cells.withColumn("upto", upto).join(todo.select("box", "before", "goal"), "box").filter(c("before") + c("upto") >= c("goal") - 0.5)
    hit = hit.groupBy("box").agg(F.min(F.struct("cell", "w", "lo", "hi", "upto")).alias("h"))
    df = todo.join(hit, "box")
    below = c("before") + c("h.upto") - c("h.w")  # bytes before the cell
    short, over = c("goal") - below, c("before") + c("h.upto") - c("goal")
    one = c("h.lo") == c("h.hi")
    last = one & (c("phase") == 2)
    left = last & (short < over)  # cut before the row: its middle is behind the goal
    right = ~left & last & (c("h.hi") < (1 << 63) - 1)  # cut behind it
    deeper = ~left & ~right & one
    cut_at = F.when(left, c("h.lo")).when(right, c("h.hi") + 1)
    at = {}
    for i, k in enumerate(KEYS):
        at[f"at_{k}"] = F.when(c("phase") == i, F.coalesce(cut_at, F.when(deeper, c("h.lo")), F.lit(LEAST))).otherwise(c(f"at_{k}"))
    news = {
        "found": left | right, "phase": F.when(deeper, c("phase") + 1).otherwise(c("phase")),
        "low": F.when(deeper, F.lit(LEAST)).otherwise(c("h.lo")), "high": F.when(deeper, F.lit((1 << 63) - 1)).otherwise(c("h.hi")), "before": below, **at,
    }
    return boxes.filter("found").unionByName(df.select("box", "shards", "first", "rows", "dim", "goal", *[v.cast(boxes.schema[k].dataType).alias(k) for k, v in news.items()]))


def _low_side(near: DataFrame, dims: list[str]) -> DataFrame:
    """The cut of small boxes, each sorted in one task: rows whose middle is not behind the goal go left."""
    near = near.withColumn("value", _value(dims))
    upto = F.sum("size").over(Window.partitionBy("box").orderBy("value", "tie", "row"))
    return near.withColumn("low_side", upto - F.col("size") / 2 <= F.col("goal"))


def tree(meta: DataFrame, n_shards: int, dims: list[str]) -> DataFrame:
    """Rows of ``meta`` (the dims, tie, row and size) with their ``shard``.

    The tree is a table, one row per box, and rows carry the number of theirs: each level
    chooses every box's widest dimension and finds all weighted medians at once: a pass sums
    bytes in CELLS cells per box, keeps the cell that holds the median and looks closer, until
    the cell is one value. Rows of one value are then cut by ``tie`` and by ``row`` the same way
    (levels of small boxes are sorted instead, with the same cuts). The driver learns how many
    boxes are still open, and nothing of their content, so any number of shards takes the
    logarithm of it in levels.
    """
    spans = meta.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))], F.sum("size").alias("w")).first()
    if n_shards < 2 or spans["w"] is None:
        return meta.withColumn("shard", F.lit(0))
    width = {d: max(1, spans[f"hi_{d}"] - spans[f"lo_{d}"]) for d in dims}
    spark = meta.sparkSession
    # read off the row, so that no plan takes the number for a constant and the join for a product
    rows = meta.withColumn("box", F.when(F.col("row").isNotNull(), 1).otherwise(0).cast("long"))
    shards = spark.createDataFrame([(1, n_shards, 0)], "box long, shards int, first int")
    done: list[DataFrame] = []
    n_boxes = 1
    while True:
        boxes = cut(_open_boxes(rows, dims, shards, width))
        half = F.floor(F.col("shards") / 2).cast("int")
        if (boxes.agg(F.max("rows")).first()[0] or 0) <= SORT_ROWS:
            parted = _low_side(_with_boxes(rows, boxes, n_boxes), dims)
        else:
            while not boxes.filter("not found").isEmpty():
                boxes = cut(_narrow(rows, boxes, n_boxes, dims))
            low = F.lit(False)
            for k in reversed(KEYS):
                low = (F.col(k) < F.col(f"at_{k}")) | ((F.col(k) == F.col(f"at_{k}")) & low)
            parted = _with_boxes(rows, boxes, n_boxes).withColumn("value", _value(dims)).withColumn("low_side", low)
        parted = parted.select(*meta.columns, F.when(F.col("low_side"), 2 * F.col("box")).otherwise(2 * F.col("box") + 1).alias("box"), F.when(F.col("low_side"), half).otherwise(F.col("shards") - half).alias("n"), F.when(F.col("low_side"), F.col("first")).otherwise(F.col("first") + half).alias("f"))
        parted = cut(parted)
        done.append(parted.filter("n = 1").select(*meta.columns, F.col("f").alias("shard")))
        shards = boxes.select(F.inline(F.array(F.struct((2 * F.col("box")).alias("box"), half.alias("shards"), "first"), F.struct((2 * F.col("box") + 1).alias("box"), (F.col("shards") - half).alias("shards"), (F.col("first") + half).alias("first")))))
        n_boxes *= 2
        if n_boxes >= n_shards:
            break
        rows = parted.filter("n > 1").drop("n", "f")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


#: Rounds without a gain of a twentieth after which shards count as even as they get.
PAIRINGS = 3


def _exchanges(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, to): for each pair of a full and an empty shard, what moves from one to the other so that
    ``want`` bytes change places as nearly as can be.

    The best of three: as many rows there as fit, the large ones first; one row there and perhaps one
    back; or the least row that is too large there, and as many rows back as make up for it. For
    the second, rows of the full shard and those of the empty one lie in one sequence by size, in
    which each finds the partner nearest to what it is too large; no pairs of rows are made. A pair
    meets in one task with the rows of its two shards. Nothing moves where no choice mends a tenth
    of the difference.
    """
    c = F.col
    give = placed.join(pairs.select("n", "shard", "want"), "shard").select("n", "want", "row", "size")
    take = placed.join(pairs.select("n", c("to").alias("shard"), "want"), "shard").select("n", "want", "row", "size")

    def fitting(rows: DataFrame, limit: str) -> DataFrame:
        upto = F.sum("size").over(Window.partitionBy("n").orderBy(c("size").desc(), "row"))
        return rows.filter(c("size") <= c(limit)).withColumn("upto", upto).filter(c("upto") <= c(limit))

    many = fitting(give, "want")
    nobody = pairs.select("n", "want", F.lit(None).cast("long").alias("row"), F.lit(0).cast("long").alias("size"))
    line = give.select("*", (c("size") - c("want")).alias("at"), F.lit(1).alias("gives"))
    line = line.unionByName(take.unionByName(nobody).select("*", c("size").cast("double").alias("at"), F.lit(0).alias("gives")))
    other = F.last(F.when(c("gives") == 0, F.struct("size", "row")), ignorenulls=True)
    for name, at in (("below", c("at")), ("above", c("at").desc())):
        line = line.withColumn(name, other.over(Window.partitionBy("n").orderBy(at, "gives", "row").rowsBetween(Window.unboundedPreceding, 0)))
    near = lambda k: F.when(c(k).isNotNull(), F.struct(F.abs(c(f"{k}.size") - c("at")).alias("off"), c("row").alias("there"), c(f"{k}.row").alias("back")))
    one = line.filter("gives = 1").groupBy("n").agg(F.min(F.least(near("below"), near("above"))).alias("one"))
    bulk = many.groupBy("n").agg((F.first("want") - F.sum("size")).alias("bulk"))
    large = give.filter("size > want").groupBy("n").agg(F.min(F.struct("size", "row")).alias("large"), F.first("want").alias("want"))
    large = large.select("n", c("large.row").alias("there"), (c("large.size") - c("want")).alias("owed"))
    change = fitting(take.join(large.select("n", "owed"), "n"), "owed")
    trade = large.join(change.groupBy("n").agg(F.sum("size").alias("paid")), "n", "left").select("n", "there", (c("owed") - F.coalesce("paid", F.lit(0))).alias("trade"))
    best = pairs.join(one, "n", "left").join(bulk, "n", "left").join(trade, "n", "left").withColumn("least", F.least("one.off", "bulk", "trade"))
    best = cut(best.filter(c("least") <= 0.9 * c("want")).withColumn("way", F.when(c("bulk") == c("least"), "bulk").when(c("one.off") == c("least"), "one").otherwise("trade")))
    to, shard = best.select("n", "to", "way"), best.select("n", "shard", "way")
    single = best.filter("way = 'one'").select(F.inline(F.array(F.struct(c("one.there").alias("row"), "to"), F.struct(c("one.back").alias("row"), c("shard").alias("to"))))).filter("row is not null")
    out = many.join(to.filter("way = 'bulk'"), "n").select("row", "to").unionByName(single)
    out = out.unionByName(best.filter("way = 'trade'").select(c("there").alias("row"), "to"))
    return out.unionByName(change.join(shard.filter("way = 'trade'"), "n").select("row", c("shard").alias("to")))


def level_out(placed: DataFrame, n_shards: int, tolerance: float = 0.005) -> DataFrame:
    """Exchange rows between shards until all are within ``tolerance`` of the mean, or it gets no better.

    The medians of a tree are as exact as its rows are small. Where a row is a good part of a shard,
    the fullest shard is paired with the emptiest, the next fullest with the next, and so on
    (``_exchanges``). Once the largest deviation has not fallen, other pairings are tried, and after
    PAIRINGS rounds in a row without a gain of a twentieth it stays. Tables of many rows per shard need no round.
    The driver sees three sums.
    """
    spark, c = placed.sparkSession, F.col
    every = spark.range(n_shards).select(c("id").cast("int").alias("shard"))
    small = F.broadcast if n_shards <= BROADCAST_BOXES else lambda df: df
    shift, least = 0, math.inf
    while True:
        sums = cut(every.join(placed.groupBy("shard").agg(F.sum("size").alias("w")), "shard", "left").select("shard", F.coalesce("w", F.lit(0)).alias("w")))
        stats = sums.agg(F.sum("w").alias("w"), F.max("w").alias("hi"), F.min("w").alias("lo")).first()
        mean = stats["w"] / n_shards
        off = max(stats["hi"] - mean, mean - stats["lo"])
        shift = 0 if off < 0.95 * least else shift + 1
        least = min(off, least)
        if off <= tolerance * mean or shift >= PAIRINGS:
            return placed
        full = sums.filter(c("w") > mean).count()
        # ranks of the full shards by what they have over and of the others by what they lack: one row a shard
        signed = sums.withColumn("excess", c("w") - F.lit(mean)).withColumn("full", c("excess") > 0)
        ranked = signed.withColumn("n", F.row_number().over(Window.partitionBy("full").orderBy(F.abs("excess").desc(), "shard")) - 1)
        give = ranked.filter("full").select("n", "shard", c("excess").alias("over"))
        give = give.withColumn("at", F.pmod(c("n") + shift, F.lit(max(full, n_shards - full))))
        take = ranked.filter("not full").select(c("n").alias("at"), c("shard").alias("to"), (-c("excess")).alias("lack"))
        pairs = give.join(take, "at").filter(F.greatest("over", "lack") > tolerance * mean)
        pairs = cut(pairs.select("n", "shard", "to", ((c("over") + c("lack")) / 2).alias("want")))
        moved = cut(_exchanges(placed, small(pairs)))
        placed = cut(placed.join(moved, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))


#: A text that exceeds a shard is cut into parts of this share of one at most.
PART = 0.001


def units_of(meta: DataFrame, n_shards: int, dims: list[str]) -> DataFrame:
    """What stays together: one row per text with its ``copies``, all their bytes as ``size`` and the
    least of their metadata; a text whose copies exceed a shard in several rows, by ``part``."""
    c = F.col
    texts = cut(meta.groupBy("tie", "text_crc32", "bytes").agg(F.count(F.lit(1)).alias("copies"), *[F.min(d).alias(d) for d in dims if d != "bytes"]))
    mean = (texts.agg(F.sum(c("copies") * c("bytes"))).first()[0] or 0) / n_shards
    whole = c("copies") * c("bytes")
    parts = F.when(whole > mean, F.least(c("copies"), F.ceil(whole / F.lit(max(1.0, PART * mean))))).otherwise(1).cast("long")
    dealt = texts.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), c("parts") - 1)))
    copies = F.expr("copies div parts + int(part < copies % parts)")
    dealt = dealt.withColumn("size", copies * c("bytes")).withColumn("copies_of", c("copies"))
    return cut(cut(dealt).withColumn("row", F.monotonically_increasing_id()))


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    Give ``n_shards``, or ``target_bytes`` for as many as bring a leaf to that size. Dimensions
    are the size and the ``metadata`` columns that the table has (strings by hash). Equal texts are
    one row of the tree, with the least of their metadata, and stay in one shard, unless their
    copies alone exceed one. A null text has size 16 and the checksum of an empty text, and is equal
    to one; null metadata is a value of its own; repeated rows are placed once each; an empty table
    gives no rows; clashing names of other columns do no harm, as only the named ones are read.
    Texts are read once, their measures (no text) are written to the checkpoint folder, and the
    tree sees one row per text. After it, texts change places where a shard is off the mean by more
    than half a hundredth. Texts are told apart by a 64-bit hash, a checksum and their size.
    """
    c = F.col
    text = F.coalesce(docs[text_column], F.lit(""))
    dims = {f"d{i}": F.coalesce(F.xxhash64(docs[n]).bitwiseAND(F.lit((1 << 30) - 1)), F.lit(-1)) for i, n in enumerate(n for n in metadata if n in docs.columns)}
    size = (F.octet_length(text) + 16).cast("long")
    meta = cut(docs.select(docs[id_column].alias("id"), size.alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"), *[e.alias(n) for n, e in dims.items()]))
    if n_shards is None:
        total = meta.agg(F.sum("bytes")).first()[0] or 0
        n_shards = max(1, math.ceil(total / target_bytes))
    units = units_of(meta, n_shards, ["bytes", *dims])
    placed = cut(tree(units, n_shards, ["bytes", *dims]))
    if n_shards > 1 and not placed.isEmpty():
        placed = level_out(placed, n_shards)
    key = ["tie", "text_crc32", "bytes"]
    rows = meta.select("id", *key)
    large = placed.filter("parts > 1")
    if large.isEmpty():
        found = rows.join(placed.select(*key, "shard"), key)
    else:
        # copies of a text that is cut are numbered and dealt over its parts; such texts are at most as many as shards
        few = cut(large.select(*key, "parts", c("copies_of").alias("n")).distinct())
        ranked = numbered(rows.join(few, key), key, ["id"], "rank")
        per = F.expr("n div parts")
        first = F.expr("n % parts") * (per + 1)
        part = F.when(c("rank") < first, F.floor(c("rank") / (per + 1))).otherwise(F.expr("n % parts") + F.floor((c("rank") - first) / per)).cast("long")
        found = ranked.withColumn("part", part).join(placed.select(*key, "part", "shard"), [*key, "part"]).select("id", *key, "shard")
        found = found.unionByName(rows.join(placed.filter("parts = 1").select(*key, "shard"), key))
    out = numbered(cut(found), ["shard"], ["tie", "id"], "slot")
    return out.select(c("id").alias(id_column), c("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), c("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39."""
    return shard(table(spark, sf_dir, "documents"), n_shards=40)
