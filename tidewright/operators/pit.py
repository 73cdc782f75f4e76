"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is cut into ranges of time with about so many each.
HOT_ROWS = 1_000_000
#: More ranges are not made of one key.
MOST_RANGES = 1000


def pit_join(fact: DataFrame, dim: DataFrame, keys: list[str], ts: str, start: str = "effective_start", end: str = "effective_end", how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each fact row with the version of ``dim`` valid at ``ts``: start <= ts < end, open end.

    As-of join without candidate pairs: facts and versions of a key lie in one sequence by time, and
    each fact takes the last version before it, if that has not ended. So the work is the number
    of facts and versions and not their product. A hot key is cut into ranges of time (by
    quantiles of its rows) that are read in different tasks; the version that holds at the start
    of a range is copied into it, one row a range.

    Versions of a key must not overlap; of versions that start together the one that ends last
    counts, and one of no length is none. Null keys and times have no version (``how="left"`` keeps
    such rows, they meet no window). Repeated facts each get their row. Columns: those of fact,
    then those of dim but its keys.
    """
    c = F.col
    rest = [n for n in dim.columns if n not in keys]
    k = [f"k{i}" for i in range(len(keys))]
    f = fact.select(*[c(f"`{n}`").alias(i) for n, i in zip(keys, k, strict=True)], c(f"`{ts}`").cast("timestamp").alias("t"), F.struct(*[c(f"`{n}`") for n in fact.columns]).alias("f"))
    v = dim.select(*[c(f"`{n}`").alias(i) for n, i in zip(keys, k, strict=True)], c(f"`{start}`").cast("timestamp").alias("t"), c(f"`{end}`").cast("timestamp").alias("e"), F.struct(*[c(f"`{n}`") for n in rest]).alias("v"))
    usable = F.lit(True)
    for i in [*k, "t"]:
        usable &= c(i).isNotNull()
    v = v.filter(usable & (c("e").isNull() | (c("e") > c("t"))))
    both = f.filter(usable).withColumns({"e": F.lit(None).cast("timestamp"), "v": F.lit(None).cast(v.schema["v"].dataType), "late": F.lit(1)})
    versions = v.withColumns({"f": F.lit(None).cast(f.schema["f"].dataType), "late": F.lit(0)})
    hot = _hot_keys(both, versions, k, hot_rows)
    if hot is not None:
        both, versions = _in_ranges(both, hot, k), _in_ranges(versions, hot, k)
        versions = versions.unionByName(_carried(versions, hot, k)).drop("bounds")
        both, k = both.drop("bounds"), [*k, "range"]
    # versions stand before facts of their instant; of several at one instant the one with the last end comes last
    order = Window.partitionBy(*k).orderBy("t", "late", c("e").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(c("late") == 0, F.struct("e", "v")), ignorenulls=True).over(order)
    found = both.unionByName(versions).withColumn("last", last).filter("late = 1")
    valid = c("last").isNotNull() & (c("last.e").isNull() | (c("t") < c("last.e")))
    if how == "inner":
        return found.filter(valid).select("f.*", "last.v.*")
    out = found.select("f.*", *[F.when(valid, c(f"last.v.`{n}`")).alias(n) for n in rest])
    return out.unionByName(f.filter(~usable).select("f.*", *[F.lit(None).cast(dim.schema[n].dataType).alias(n) for n in rest]))


def _hot_keys(facts: DataFrame, versions: DataFrame, k: list[str], hot_rows: int) -> DataFrame | None:
    """(keys, bounds) of keys of more than ``hot_rows`` rows: at most total / hot_rows keys, a few bounds each."""
    rows = facts.select(*k, "t").unionByName(versions.select(*k, "t"))
    many = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
    if many.isEmpty():
        return None
    ranges = F.least(F.ceil(F.col("n") / hot_rows), F.lit(MOST_RANGES)).cast("int")
    # quantiles of hot keys alone; their sketches combine map-side
    fine = rows.join(many, k, "left_semi").groupBy(*k).agg(F.percentile_approx("t", [i / MOST_RANGES for i in range(1, MOST_RANGES)], 10_000).alias("q"))
    picked = F.transform(F.sequence(F.lit(1), F.col("ranges") - 1), lambda i: F.element_at("q", F.round(i * MOST_RANGES / F.col("ranges")).cast("int")))
    hot = fine.join(many.withColumn("ranges", ranges), k).select(*k, F.array_distinct(F.when(F.col("ranges") > 1, picked).otherwise(F.array().cast("array<timestamp>"))).alias("bounds"))
    return hot


def _in_ranges(df: DataFrame, hot: DataFrame, k: list[str]) -> DataFrame:
    """Add the number of the range of time that a row lies in: how many bounds are not behind it; 0 for other keys."""
    above = F.size(F.filter("bounds", lambda b: b <= F.col("t")))
    return df.join(hot, k, "left").withColumn("range", F.when(F.col("bounds").isNotNull(), above).otherwise(0))


def _carried(versions: DataFrame, hot: DataFrame, k: list[str]) -> DataFrame:
    """The last version before each range of a hot key, as a row of that range: the last of every range
    that has one, carried on over the ranges behind it."""
    own = versions.filter("bounds is not null").groupBy(*k, "range").agg(F.max_by(F.struct("t", "e", "v"), F.struct("t", F.col("e").isNull().alias("open"), "e")).alias("own"))
    every = hot.select(*k, F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("range")).join(own, [*k, "range"], "left")
    before = F.last("own", ignorenulls=True).over(Window.partitionBy(*k).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = every.withColumn("before", before).filter("before is not null")
    none = {n: F.lit(None).cast(versions.schema[n].dataType) for n in ("f", "bounds")}
    return carried.select(*k, "range", "before.t", "before.e", "before.v", F.lit(0).alias("late"), *[v.alias(n) for n, v in none.items()])

