"""Change logs to version histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dollars_to_cents, surrogate_key

ITEM = "struct<item_id:string,brand:string,name:string,price:string,category:string,description:string,active:boolean>"
SCHEMA = f"op string, before {ITEM}, after {ITEM}, ts_ms string"


def parse(bronze: DataFrame) -> DataFrame:
    """Change rows; a delete takes its key from the row before it."""
    c = F.col
    df = bronze.select("*", F.explode(F.array(F.from_json("raw_value", SCHEMA))).alias("p")).filter(c("p.op").isin("c", "u", "d"))
    item = F.coalesce(c("p.after"), c("p.before"))
    return df.select(
        c("p.op").alias("op"),
        c("p.ts_ms").try_cast("long").alias("ts_ms"),
        c("kafka_offset").alias("seq"),
        item["item_id"].alias("item_id"),
        item["brand"].alias("brand"),
        item["name"].alias("name"),
        dollars_to_cents(item["price"].try_cast("double")).alias("price_cents"),
        item["category"].alias("category"),
        item["description"].alias("description"),
        item["active"].alias("is_active"),
    ).filter(c("item_id").isNotNull() & c("ts_ms").isNotNull())


def to_history(changes: DataFrame, keys: list[str], order: tuple[str, str] = ("ts_ms", "seq")) -> DataFrame:
    """Versions from an ordered log: each runs to the next change of its key, a delete closes
    without opening, a later create opens again, and of several changes at one instant the last
    counts, so that a repeated change is none. At most one version of a key is current, and it has no end."""
    ts, seq = order
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    df = changes.withColumn("__next", F.lead(ts).over(w))
    df = df.filter((F.col("op") != "d") & (F.col("__next").isNull() | (F.col("__next") > F.col(ts))))
    at = lambda c: F.timestamp_millis(F.col(c))
    return df.withColumn("effective_start", at(ts)).withColumn("effective_end", at("__next")).withColumn("is_current", F.col("__next").isNull()).drop("op", ts, seq, "__next")


def apply_changes(history: DataFrame | None, changes: DataFrame, keys: list[str], order: tuple[str, str] = ("ts_ms", "seq")) -> DataFrame:
    """The history after one more batch of ``changes``, the same as that of the whole log.

    Only keys of the batch are rebuilt: their versions count as changes at their starts, and an
    end that no version follows as a delete, so late updates find their place and a repeated
    batch changes nothing. At one instant the batch wins. A history keeps no trace of a delete
    that closed nothing when it came: deletes must not overtake the versions they close.
    """
    if history is None:
        return to_history(changes, keys, order)
    ts, seq = order
    touched = changes.select(*keys).distinct()
    old, rest = history.join(touched, keys, "left_semi"), history.join(touched, keys, "left_anti")
    follows = F.lead("effective_start").over(Window.partitionBy(*keys).orderBy("effective_start")) == F.col("effective_end")
    old = old.withColumn("__gone", F.col("effective_end").isNotNull() & ~F.coalesce(follows, F.lit(False)))
    values = [c for c in changes.columns if c not in ("op", ts, seq)]
    at = lambda c, op: F.struct(F.lit(op).alias("op"), F.unix_millis(c).alias(ts))
    events = F.explode(F.when(F.col("__gone"), F.array(at("effective_start", "u"), at("effective_end", "d"))).otherwise(F.array(at("effective_start", "u")))).alias("e")
    known = old.select(*values, events).select("e.op", f"e.{ts}", F.lit(-1).cast("long").alias(seq), *values)
    return rest.unionByName(to_history(known.unionByName(changes.select(*known.columns)), keys, order))


def menu_history(bronze: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Versions of menu items; with a ``history``, that one after the changes in ``bronze``."""
    hist = apply_changes(None if history is None else history.drop("menu_item_hk"), parse(bronze), ["brand", "item_id"])
    return hist.select(surrogate_key(F.col("brand"), F.col("item_id")).alias("menu_item_hk"), *hist.columns)
