"""Declarative expectations, evaluated in one aggregation per table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``kind``: not_null, between, in_set, match, not_match, unique, row_count, one_current,
    has_state, columns, rate_between or drift_below. ``args``: what the kind needs."""

    kind: str
    column: str = ""
    args: dict[str, Any] = field(default_factory=dict)


def _violation(r: Rule) -> Column | None:
    c, a = F.col(r.column) if r.column else None, r.args
    if r.kind == "not_null":
        return c.isNull()
    if r.kind == "between":
        return ~c.between(a["min"], a["max"])
    if r.kind == "in_set":
        return ~c.isin(*a["values"])
    if r.kind == "match":
        return ~c.cast("string").rlike(a["regex"])
    if r.kind == "not_match":
        return c.cast("string").rlike(a["regex"])
    return None


def run(df: DataFrame, suite: str, rules: list[Rule]) -> DataFrame:
    """Rows (suite, rule, column, success, unexpected_count, total).

    All row-level rules are counted in one pass (nulls are only the concern of not_null); each
    rule on groups adds one aggregation.
    """
    rows = [(i, r, v) for i, r in enumerate(rules) if (v := _violation(r)) is not None]
    out: DataFrame | None = None
    spark = df.sparkSession

    def add(part: DataFrame) -> None:
        nonlocal out
        out = part if out is None else out.unionByName(part)

    def line(r: Rule, bad: Column, total: Column, ok: Column | None = None) -> Column:
        bad = F.coalesce(bad, F.lit(0)).cast("long")
        return F.struct(F.lit(suite).alias("suite"), F.lit(r.kind).alias("rule"), F.lit(r.column).alias("column"), (bad == 0 if ok is None else F.coalesce(ok, F.lit(False))).alias("success"), bad.alias("unexpected_count"), total.cast("long").alias("total"))

    if rows:
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(v).alias(f"v{i}") for i, _, v in rows])
        add(one.select(F.inline(F.array(*[line(r, F.col(f"v{i}"), F.col("n")) for i, r, _ in rows]))))
    for r in rules:
        if _violation(r) is not None:
            continue
        a, n = r.args, F.sum("n")
        if r.kind in ("unique", "one_current"):
            src = df.filter("is_current") if r.kind == "one_current" else df
            keys = r.column.split(",")
            one = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("bad"), n.alias("n"))
            add(one.select(F.inline(F.array(line(r, F.col("bad"), F.coalesce("n", F.lit(0)))))))
        elif r.kind == "row_count":
            one = df.agg(F.count(F.lit(1)).alias("n"))
            add(one.select(F.inline(F.array(line(r, F.abs(F.col("n") - a["n"]), F.col("n"))))))
        elif r.kind == "has_state":
            one = df.groupBy(r.column).agg(F.bool_or(F.col(a["state_column"]) == a["state"]).alias("has")).agg(F.count_if(~F.coalesce("has", F.lit(False))).alias("bad"), F.count(F.lit(1)).alias("n"))
            add(one.select(F.inline(F.array(line(r, F.col("bad"), F.col("n"))))))
        elif r.kind == "columns":
            missing = [c for c in a["names"] if c not in df.columns]
            add(spark.range(1).select(F.inline(F.array(line(r, F.lit(len(missing)), F.lit(len(a["names"])))))))
        elif r.kind == "rate_between":
            one = df.agg(F.count_if(a["flag"]).alias("k"), F.count(F.lit(1)).alias("n"))
            add(one.select(F.inline(F.array(line(r, F.col("k"), F.col("n"), (F.col("k") / F.nullif("n", F.lit(0))).between(a["min"], a["max"]))))))
        elif r.kind == "drift_below":
            w = Window.partitionBy(a["by"]).orderBy(*a["order"])
            one = df.withColumn("__d", F.abs(F.col(r.column) - F.lag(r.column).over(w))).agg(F.count_if(F.col("__d") >= a["limit"]).alias("bad"), F.count(F.lit(1)).alias("n"))
            add(one.select(F.inline(F.array(line(r, F.col("bad"), F.col("n"))))))
        else:
            raise ValueError(f"no rule named {r.kind}")
    if out is None:
        raise ValueError("the suite is empty")
    return out


def observed_write(df: DataFrame, write: Callable[[DataFrame], None], suite: str, rules: list[Rule]) -> DataFrame:
    """Write ``df`` by ``write`` and give the results of its row-level rules, as ``run`` does, from the
    same scan: the counts are metrics that the writing tasks keep. Rules on groups need a pass of
    their own and are an error here."""
    if any(_violation(r) is None for r in rules) or not rules:
        raise ValueError("only rules on single rows can be observed, one at least")
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(_violation(r)).alias(f"v{i}") for i, r in enumerate(rules)]))
    got = seen.get
    rows = [(suite, r.kind, r.column, got[f"v{i}"] == 0, got[f"v{i}"], got["n"]) for i, r in enumerate(rules)]
    return df.sparkSession.createDataFrame(rows, "suite string, rule string, column string, success boolean, unexpected_count long, total long")


#: The expectation suites of the star schema.
FACT_ORDER = [
    *[Rule("not_null", c) for c in ("customer_hk", "kitchen_key", "brand_key", "date_key", "time_key")],
    Rule("between", "order_total_cents", {"min": 100, "max": 100_000}),
    Rule("between", "item_count", {"min": 1, "max": 20}),
    Rule("in_set", "platform", {"values": ["uber_eats", "doordash", "own_app"]}),
    Rule("match", "date_key", {"regex": r"^\d{8}$"}),
    Rule("unique", "platform_order_id"),
]
DIM_CUSTOMER = [
    Rule("unique", "customer_hk"),
    Rule("not_null", "customer_hk"),
    Rule("not_null", "email_masked"),
    Rule("not_match", "email_masked", {"regex": "@"}),
    Rule("between", "platform_count", {"min": 1, "max": 3}),
    Rule("in_set", "is_current", {"values": [True, False]}),
]
DIM_MENU_ITEM = [
    Rule("unique", "menu_item_key"),
    Rule("not_null", "item_id"),
    Rule("between", "price", {"min": 0.99, "max": 50.0}),
    Rule("in_set", "is_current", {"values": [True, False]}),
    Rule("not_null", "valid_from"),
]
