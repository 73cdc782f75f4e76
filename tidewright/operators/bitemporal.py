"""Satellites with two times: when a value held, and when the table knew it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import change_hash


def apply_batch(target: DataFrame | None, batch: DataFrame, keys: list[str], tracked: list[str], eff_ts: str, known: Column) -> DataFrame:
    """The table after one more batch, whose rows became known at ``known``.

    Each row of the table is an interval of a key: keys, tracked, row_hash, effective_start and
    effective_end say what held when, known_from and known_to since when and until when the table
    said so. A change that comes late splits the interval that it falls into: the old row is closed
    at ``known`` and two shorter ones open. Nothing is ever overwritten, so what was known at any
    time can be read again (``known_at``).

    Every observed change keeps a row, one that repeats its predecessor's values too, as a later
    batch may put another value between the two; ``versions`` merges such neighbours. Of changes at
    one instant the one with the greatest hash of its values holds, whichever came first. So batches
    in any order, and batches that come twice, lead to one history. Only keys of the batch are
    sorted; all other rows pass through. ``known`` must not go back from batch to batch. Rows with
    a null key or time are no change.
    """
    c, at = F.col, known.cast("timestamp")
    cols = [*keys, *tracked, "effective_start"]
    empty = F.lit(None).cast("timestamp")
    new = batch.dropna(subset=[*keys, eff_ts]).select(*keys, *tracked, c(eff_ts).alias("effective_start"))
    new = new.withColumns({"effective_end": empty, "known_from": at, "__new": F.lit(True)})
    rows, rest = new, None
    if target is not None:
        touched = new.select(*keys).distinct()
        if "row_hash" not in target.columns:  # it follows from the values, so a table may be kept without it
            target = target.withColumn("row_hash", change_hash(*[c(t) for t in tracked]))
        now = target.filter("known_to is null")
        old = now.join(touched, keys, "left_semi").select(*cols, "effective_end", "known_from", F.lit(False).alias("__new"))
        rest = target.filter("known_to is not null").unionByName(now.join(touched, keys, "left_anti"))
        rows = old.unionByName(new)
    # rows meet by their keys once, and without the hash of their values, which is longer than they are
    rows = rows.repartition(*keys).withColumn("row_hash", change_hash(*[c(t) for t in tracked]))
    # of several rows of one instant the first in this order holds; a row that is there goes before its repeats
    line = Window.partitionBy(*keys).orderBy("effective_start", c("row_hash").desc(), c("__new"))
    first = ~c("effective_start").eqNullSafe(F.lag("effective_start").over(line))
    rows = rows.withColumn("__holds", first).withColumn("__start", F.when(c("__holds"), c("effective_start")))
    rows = rows.withColumn("__end", F.expr("lead(__start) ignore nulls").over(line))
    fits = c("__holds") & ~c("__new") & c("__end").eqNullSafe(c("effective_end"))
    version = lambda end, since, until: F.struct(end.alias("effective_end"), since.alias("known_from"), until.alias("known_to"))
    kept = F.when(fits, version(c("effective_end"), c("known_from"), empty))
    opened = F.when(c("__holds") & ~fits, version(c("__end"), at, empty))
    closed = F.when(~c("__new") & ~fits & (c("known_from") < at), version(c("effective_end"), c("known_from"), at))
    out = rows.select(*keys, *tracked, "row_hash", "effective_start", F.inline(F.filter(F.array(kept, opened, closed), lambda v: v.isNotNull())))
    return out if rest is None else rest.select(*out.columns).unionByName(out)


def known_at(table: DataFrame, when: Column | None = None) -> DataFrame:
    """The rows that the table held true at ``when``, or holds now."""
    if when is None:
        return table.filter("known_to is null")
    return table.filter((F.col("known_from") <= when) & (F.col("known_to").isNull() | (F.col("known_to") > when)))


def versions(rows: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """The version history in ``rows`` of ``known_at``: neighbours of equal values are one version.
    Columns: keys, tracked, effective_start, effective_end, is_current."""
    line = Window.partitionBy(*keys).orderBy("effective_start")
    values = F.struct(*tracked)  # shorter than their hash
    changed = rows.select(*keys, *tracked, "effective_start").withColumn("__last", F.lag(values).over(line)).filter(~F.col("__last").eqNullSafe(values))
    out = changed.withColumn("effective_end", F.lead("effective_start").over(line))
    return out.select(*keys, *tracked, "effective_start", "effective_end", F.col("effective_end").isNull().alias("is_current"))
