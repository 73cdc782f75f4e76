"""Cross-platform identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mask, match_method
from .graph import components, cut
from .upsert import upsert


def bridge(orders: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """One row per customer, platform and platform id, seen from its first to its last event."""
    keys = ["customer_hk", "platform", "platform_customer_id"]
    new = orders.dropna(subset=["customer_key", "platform_customer_id"]).groupBy(F.col("customer_key").alias("customer_hk"), "platform", "platform_customer_id").agg(F.min("raw_email").alias("raw_email"), F.min("order_timestamp").alias("first_seen"), F.max("order_timestamp").alias("last_seen"))
    new = new.withColumn("match_method", match_method(F.col("raw_email"))).select(*keys, "raw_email", "match_method", "first_seen", "last_seen")
    return upsert(target, new, keys, {"last_seen": F.greatest("t.last_seen", "s.last_seen"), "first_seen": F.least("t.first_seen", "s.first_seen")})


def with_confidence(b: DataFrame) -> DataFrame:
    """Email hash and a confidence by match method; the raw address goes."""
    return b.withColumn("email_hash", mask(F.col("raw_email"))).withColumn("confidence", F.when(F.col("match_method") == "exact_email", 1.0).otherwise(0.6)).drop("raw_email")


def _shorter(names: Column) -> Column:
    """All strings that lack one character of one in the array ``names``."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.substr(n, F.lit(1), i - 1), F.substr(n, i + 1)))
    return F.array_distinct(F.flatten(F.transform(F.filter(names, lambda n: F.length(n) > 0), one)))


def near_names(names: DataFrame, block: list[str], name: str, most: int) -> DataFrame:
    """Distinct names of a block that differ by at most ``most`` edits: block, ``name``, __other, distance,
    with name <= __other; a name is near itself.

    Two such names share a string that both become by dropping up to ``most`` characters, so
    different names are joined on (block, that string): names in one group are near each other,
    whatever prefix a whole block shares. A name of n characters has about n ** most / 2 of them.

    A short table of names makes many pairs: the strings are dealt over all shuffle partitions, which
    adaptive execution, that sees only their size, would join to a few. Pairs are measured where they
    are made, so that only near ones are gathered.
    """
    keys = step = F.array(name)
    for _ in range(most):
        step = _shorter(step)
        keys = F.concat(keys, step)
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = names.select(*block, name).distinct().withColumn("__key", F.explode(F.array_distinct(keys))).repartition(tasks, *block, "__key")
    other = keyed.withColumnRenamed(name, "__other")
    near = keyed.join(other, [*block, "__key"]).filter(F.col(name) <= F.col("__other"))
    # -1: more than ``most``
    return near.select(*block, name, "__other", F.levenshtein(name, "__other", most).alias("distance")).filter("distance >= 0").distinct()


def fuzzy(people: DataFrame, id_column: str, name: str, block: list[str], most: int = 2) -> DataFrame:
    """Pairs (a < b) of one block whose names differ by at most ``most`` edits.

    ``block`` and ``name`` may be anything the pairs should agree in or be near in, a name or an
    address. Null and empty names have no pair. Columns: the block's, a, b, na, nb, distance (with an
    underscore where the block has a column of that name).
    """
    inner = [f"__block{i}" for i in range(len(block))]
    out = [n + "_" * (n in block) for n in ("a", "b", "na", "nb", "distance")]
    src = people.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(block, inner, strict=True)], F.col(id_column).alias("__id"), F.lower(F.trim(F.col(name))).alias("__name")).filter("__name <> ''")
    near = near_names(src, inner, "__name", most)
    left, right = src.withColumnRenamed("__id", "__a"), src.withColumnsRenamed({"__id": "__b", "__name": "__other"})
    pairs = near.join(left, [*inner, "__name"]).join(right, [*inner, "__other"]).filter(F.col("__a") != F.col("__b"))
    # the two names of a pair come in either order; of equal names every pair comes twice
    pairs = pairs.filter((F.col("__name") != F.col("__other")) | (F.col("__a") < F.col("__b")))
    turn = F.col("__a") > F.col("__b")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return pairs.select(*[F.col(i).alias(c) for c, i in zip(block, inner, strict=True)], *[c.alias(n) for c, n in zip((pick("__a", "__b"), pick("__b", "__a"), pick("__name", "__other"), pick("__other", "__name"), F.col("distance")), out, strict=True)])


def identities(people: DataFrame, id_column: str, email: str, name: str, block: list[str], most: int = 1, known: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """One row per person: id, identity_key, match_method, match_confidence, however they are matched.

    People of one cleaned email are one identity (``exact_email``, 1.0). Those without an email are
    joined by names within ``most`` edits of each other inside a block (say a street), in chains;
    such a group goes to the email identity with the nearest name, of equally near ones to the one
    with the least key, and so never joins two emails. ``fuzzy_name_address`` has a confidence of 0.9
    less 0.1 for each edit to the nearest other name, 0.6 at least; who stands alone is known by id
    alone (``platform_id_fallback``, 0.6).

    Keys survive: a group of which ``known`` (id, identity_key) has members keeps the least of
    their keys, else the key is the hash of its email or of its least id. ``overrides`` (id,
    identity_key) count for the people that they name (``manual_override``, 1.0).

    Only distinct names are compared and only they make links; people find their name's group by one
    join. So a name that many people bear costs a row each. A null name matches nobody; a null block
    is a block of its own; ids are unique.
    """
    c = F.col
    at = [f"__b{i}" for i in range(len(block))]
    kind = people.schema[id_column].dataType
    bare = F.lower(F.trim(c(name)))
    src = people.select(c(id_column).alias("id"), F.nullif(F.lower(F.trim(c(email))), F.lit("")).alias("email"), F.nullif(bare, F.lit("")).alias("name"), *[F.coalesce(c(f"`{n}`").cast("string"), F.lit("\0")).alias(i) for n, i in zip(block, at, strict=True)])
    src = src.withColumn("node", F.when(c("name").isNotNull(), F.xxhash64(*at, "name")))
    bearers = cut(src.filter("node is not null").groupBy(*at, "name", "node").agg(F.min("email").alias("mail"), F.count_if(c("email").isNull()).alias("lone"), F.count(F.lit(1)).alias("n")))
    near = near_names(bearers.select(*at, "name"), at, "name", most)
    side = lambda p, n: bearers.select(*at, c("name").alias(n), c("node").alias(f"{p}node"), c("mail").alias(f"{p}mail"), (c("lone") > 0).alias(f"{p}lone"), c("n").alias(f"{p}n"))
    links = cut(near.join(side("a", "name"), [*at, "name"]).join(side("b", "__other"), [*at, "__other"]).select("anode", "amail", "alone", "an", "bnode", "bmail", "blone", "bn", "distance"))

    groups = components(links.filter("alone and blone").select(c("anode").alias("a"), c("bnode").alias("b")))
    other = links.select(c("bnode").alias("anode"), c("bmail").alias("amail"), c("blone").alias("alone"), c("bn").alias("an"), c("anode").alias("bnode"), c("amail").alias("bmail"), c("alone").alias("blone"), c("an").alias("bn"), "distance").filter("anode <> bnode")
    both = links.unionByName(other).filter("alone")
    # of every name of people without email: how near another bearer is, and the nearest email
    shared = F.when((c("anode") != c("bnode")) | (c("an") > 1), c("distance"))
    own = both.groupBy(c("anode").alias("node")).agg(F.min(shared).alias("edits"), F.min(F.when(c("bmail").isNotNull(), F.struct("distance", c("bmail").alias("email")))).alias("best"))
    own = own.join(groups, "node", "left").select("node", "edits", "best", F.coalesce("root", "node").alias("group"))
    target = cut(own.groupBy("group").agg(F.min("best").alias("best")))
    named = cut(own.select("node", "edits", "group").join(target, "group").select("node", "edits", "group", c("best.email").alias("to_email")))

    lone = src.filter("email is null").select("id", "node").join(named, "node", "left")
    # nobody else bears the name or one near it
    alone = c("to_email").isNull() & c("edits").isNull()
    lone = lone.select("id", c("to_email").alias("email"), F.when(~alone, c("group")).alias("group"), "edits")
    mailed = src.filter("email is not null").select("id", "email", F.lit(None).cast("long").alias("group"), F.lit(None).cast("int").alias("edits"), F.lit("exact_email").alias("match_method"))
    method = F.when(c("email").isNotNull() | c("group").isNotNull(), "fuzzy_name_address").otherwise("platform_id_fallback")
    rows = mailed.unionByName(lone.withColumn("match_method", method))
    unit = F.when(c("email").isNotNull(), F.concat(F.lit("e"), "email")).when(c("group").isNotNull(), F.concat(F.lit("g"), c("group").cast("string"))).otherwise(F.concat(F.lit("p"), c("id").cast("string")))
    rows = cut(rows.withColumn("unit", unit))
    keys = rows.groupBy("unit").agg(F.min("email").alias("email"), F.min("id").alias("least"))
    old = rows.select("id", "unit").join(known.select(c(id_column).alias("id"), "identity_key"), "id").groupBy("unit").agg(F.min("identity_key").alias("kept")) if known is not None else None
    keys = keys.withColumn("kept", F.lit(None).cast("string")) if old is None else keys.join(old, "unit", "left")
    keys = cut(keys.select("unit", F.coalesce("kept", F.sha2(F.coalesce("email", F.concat(F.lit("id "), c("least").cast("string"))), 256)).alias("identity_key")))
    edits = F.coalesce("edits", F.lit(3))
    confidence = F.when(c("match_method") == "exact_email", 1.0).when(c("match_method") == "fuzzy_name_address", F.round(F.greatest(F.lit(0.6), 0.9 - 0.1 * edits), 1)).otherwise(0.6)
    out = rows.join(keys, "unit").select("id", "identity_key", "match_method", confidence.alias("match_confidence"))
    if overrides is not None:
        said = overrides.select(c(id_column).cast(kind).alias("id"), c("identity_key").alias("said"))
        out = out.join(said, "id", "left").select("id", F.coalesce("said", "identity_key").alias("identity_key"), F.when(c("said").isNotNull(), "manual_override").otherwise(c("match_method")).alias("match_method"), F.when(c("said").isNotNull(), 1.0).otherwise(c("match_confidence")).alias("match_confidence"))
    return out.withColumnRenamed("id", id_column)
