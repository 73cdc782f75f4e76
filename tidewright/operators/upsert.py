"""Snapshot upserts: each returns the new state of a table, for any storage format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import change_hash


def insert_only(target: DataFrame | None, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of unseen keys are added; known rows stay as they are. ``source`` has one row per key."""
    fresh = source.dropna(subset=keys)
    return fresh if target is None else target.unionByName(fresh.join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame | None, source: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """Full-outer merge. ``update``: column -> expression over t.<c> and s.<c> for matched rows;
    columns not named keep the target's value; without it the source's row wins whole."""
    if target is None:
        return source
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    flag = "__in"
    j = target.withColumn(flag, F.lit(1)).alias("t").join(source.withColumn(flag, F.lit(1)).alias("s"), on, "full")
    in_t, in_s = F.col(f"t.{flag}").isNotNull(), F.col(f"s.{flag}").isNotNull()
    cols = []
    for c in target.columns:
        both = (update or {}).get(c, F.col(f"t.{c}")) if update is not None else F.col(f"s.{c}")
        cols.append(F.when(in_t & in_s, both).when(in_s, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return j.select(*cols)


def scd2_apply(target: DataFrame | None, source: DataFrame, keys: list[str], tracked: list[str], eff_ts: str) -> DataFrame:
    """Versioned rows after a batch that may hold several changes per key.

    A source row opens a version if its tracked values differ from those just before it, so a
    value that returns (A, B, A) is a new version and a repeated batch changes nothing. Rows not
    later than a key's current version are ignored (``late_changes`` gives them). Result: keys, tracked, row_hash,
    effective_start, effective_end, is_current; exactly one current row per key. Only keys of the
    batch are shuffled and sorted; all other rows pass through.
    """
    c = F.col
    cols = [*keys, *tracked]
    new = source.dropna(subset=keys).select(*cols, change_hash(*[c(t) for t in tracked]).alias("row_hash"), c(eff_ts).alias("effective_start"), F.lit(1).alias("__new")).dropDuplicates([*keys, "row_hash", "effective_start"])
    rest = None
    if target is not None:
        current, touched = target.filter("is_current"), new.select(*keys).distinct()
        rest = target.filter(~c("is_current")).unionByName(current.join(touched, keys, "left_anti").select(*target.columns))
        old = current.join(touched, keys, "left_semi")
        new = old.select(*cols, "row_hash", "effective_start", F.lit(0).alias("__new")).unionByName(new)
    by_key = Window.partitionBy(*keys)
    in_time = by_key.orderBy("effective_start", "__new", "row_hash")
    base = F.max(F.when(c("__new") == 0, c("effective_start"))).over(by_key)
    df = new.withColumn("__base", base).filter((c("__new") == 0) | c("__base").isNull() | (c("effective_start") > c("__base")))
    # one version per instant: the last in order wins
    df = df.withColumn("__next", F.lead("effective_start").over(in_time)).filter(c("__next").isNull() | (c("__next") > c("effective_start")))
    df = df.withColumn("__prev", F.lag("row_hash").over(in_time)).filter(c("__prev").isNull() | (c("__prev") != c("row_hash")))
    end = F.lead("effective_start").over(in_time)
    df = df.withColumn("effective_end", end).withColumn("is_current", c("effective_end").isNull())
    out = df.select(*cols, "row_hash", "effective_start", "effective_end", "is_current")
    return out if rest is None else rest.select(*out.columns).unionByName(out)


def late_changes(target: DataFrame, source: DataFrame, keys: list[str], tracked: list[str], eff_ts: str) -> DataFrame:
    """Rows of ``source`` that ``scd2_apply`` would ignore as older than their key's current version.

    Repeats of a version that is there are no late changes. Route them to a rebuild of their keys.
    """
    c = F.col
    current = target.filter("is_current").select(*[c(k).alias(f"__{k}") for k in keys], c("effective_start").alias("__start"))
    on = c(eff_ts) <= c("__start")
    for k in keys:
        on &= c(k) == c(f"__{k}")
    late = source.dropna(subset=keys).join(current, on, "left_semi").withColumn("row_hash", change_hash(*[c(t) for t in tracked]))
    known = target.select(*keys, "row_hash", c("effective_start").alias(eff_ts))
    return late.join(known, [*keys, "row_hash", eff_ts], "left_anti").select(*source.columns)
