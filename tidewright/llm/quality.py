"""Quality rules: every rule is evaluated once into a bitmask; policies are masks over it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_folder, table, words_of

#: Bit of each rule. Never reuse a bit: stored ledgers outlive policies.
RULES = {
    "few_words": 0,
    "repeated_windows": 1,
    "symbols": 2,
    "duplicate_lines": 3,
    "long_words": 4,
    "short_words": 5,
    "capitals": 6,
    "exclamations": 7,
    "stutter": 8,
}
BASE_RULES = ("few_words", "repeated_windows")
#: Policy version -> the rules that reject.
POLICIES = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "symbols", "long_words", "short_words", "capitals", "exclamations", "stutter"),
    # repeated lines can also be left to line deduplication, as v1 does
    "strict": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r] for r in rules)


def repeated_window_words(words: Column, grams: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more.

    ``grams`` are window hashes. Equal windows have equal hashes, so where no hash repeats the
    answer is 0 without looking at a string; otherwise windows are compared as strings.
    """
    pairs = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - width),
            lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)]).alias("w"), i.alias("i")),
        )
    )

    def covered(p: Column) -> Column:
        same = lambda j, k: F.get(p, j)["w"] == F.get(p, k)["w"]
        hit = F.filter(p, lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def spread(at: Column) -> Column:
        gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), at, lambda b, a: F.when(b.isNotNull(), F.least(F.lit(width), b - a)).otherwise(F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    # transform over a one-element array binds a value once for all uses inside the lambda
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    exact = bound(pairs, lambda p: bound(covered(p), spread))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(exact).cast("long")


def ledger(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``ledger``: a struct of measurements and ``bits`` of failed rules.

    Narrow, built-in functions only. Null and empty texts have no words (they fail ``few_words``
    and no ratio rule); repeated rows are measured alike. Existing columns keep their values: the
    one added struct is named ``ledger``, with underscores appended if that name is taken.
    """
    t, name = fresh(docs, "__t"), fresh(docs, "ledger")
    w, g, m = fresh(docs, "__words"), fresh(docs, "__grams"), fresh(docs, "__m")
    width = 5
    df = docs.withColumn(t, F.coalesce(docs[text_column], F.lit("")))
    df = df.withColumn(w, words_of(F.col(t)))
    windows = F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(width)])))
    df = df.withColumn(g, F.coalesce(windows, F.array().cast("array<bigint>")))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(t), F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")), F.lit(0)).alias("n_dup_lines"),
        repeated_window_words(F.col(w), F.col(g), width).alias("n_repeat_words"),
        F.size(F.array_distinct(F.filter(F.split(F.col(t), "\n"), lambda x: x != ""))).cast("long").alias("n_lines"),
        F.regexp_count(F.col(t), F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(F.col(t), F.lit("!")).cast("long").alias("n_exclamations"),
        F.size(F.filter(F.col(w), lambda x, i: F.coalesce(x == F.get(F.col(w), i - 1), F.lit(False)))).cast("long").alias("n_stutter"),
    )
    # a generator keeps filters on the ledger above the measuring, which then runs once per row
    df = df.select("*", F.explode(F.array(measures)).alias(m))
    x = lambda c: F.col(m)[c]
    some = x("n_words") > 0
    fails = {
        "few_words": x("n_words") < 10,
        "repeated_windows": 100 * x("n_repeat_words") > 20 * x("n_words"),
        "symbols": 100 * x("n_symbols") > 10 * x("n_words"),
        "duplicate_lines": 100 * x("n_dup_lines") > 30 * (x("n_dup_lines") + x("n_lines")),
        "long_words": some & (x("word_chars") > 15 * x("n_words")),
        "short_words": some & (x("word_chars") < 2 * x("n_words")),
        "capitals": some & (100 * x("n_capitals") > 50 * x("word_chars")),
        "exclamations": 100 * x("n_exclamations") > 20 * x("n_words"),
        "stutter": 100 * x("n_stutter") > 25 * x("n_words"),
    }
    bits = F.lit(0).cast("long")
    for rule, bit in RULES.items():
        bits = bits.bitwiseOR(F.when(fails[rule], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn(name, F.struct(f"{m}.*", bits.alias("bits"))).drop(t, w, g, m)


def kept(bits: Column, policy: str) -> Column:
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(bits: DataFrame, policy: str, column: str = "bits") -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects.

    Works on the stored ledger alone: one map-side-combined aggregation, no text is read.
    """
    m = F.col(column).bitwiseAND(F.lit(mask(POLICIES[policy])))
    aggs = []
    for r in POLICIES[policy]:
        b = F.lit(1 << RULES[r])
        aggs += [F.count_if(m.bitwiseAND(b) != 0).alias(f"{r}_f"), F.count_if(m == b).alias(f"{r}_o")]
    one = bits.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = [F.struct(F.lit(r).alias("rule"), F.col(f"{r}_f").alias("n_failed"), F.col(f"{r}_o").alias("n_only"), F.col("n").alias("n_docs")) for r in POLICIES[policy]]
    return one.select(F.inline(F.array(*rows)))


def reject(docs: DataFrame, policy: str = "v1", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass ``policy``, columns unchanged."""
    name = fresh(docs, "ledger")
    return ledger(docs, text_column).filter(kept(F.col(name)["bits"], policy)).drop(name)


def store(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write the ledger of ``docs`` to ``path`` and read it: id, measurements and bits, no text.

    Every rule is evaluated once, here. Policies, new ones too, ablations and checks against
    labels read the stored bits. One row per row of ``docs``, repeated ids and all.
    """
    out = ledger(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "text").select("id", F.col("ledger.*"))
    out.withColumnRenamed("id", id_column).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def policy_table(stored: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id") -> DataFrame:
    """Per policy: documents, kept ones and, with ``labels`` (id, quality 1 or 0), the kept and all of
    either label. One aggregation over the stored bits; the labels are joined once."""
    df = stored.select(id_column, "bits")
    if labels is None:
        df = df.withColumn("quality", F.lit(None).cast("long"))
    else:
        df = df.join(labels.select(id_column, "quality"), id_column, "left")
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), kept(F.col("bits"), p).alias("kept")) for p in POLICIES])).alias("p")
    good, bad, k = F.col("quality") == 1, F.col("quality") == 0, F.col("p.kept")
    g = df.select("quality", rows).groupBy(F.col("p.policy").alias("policy"))
    return g.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(k).alias("n_kept"), F.count_if(good).alias("n_good"), F.count_if(good & k).alias("good_kept"), F.count_if(bad).alias("n_bad"), F.count_if(bad & k).alias("bad_kept"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger of all documents under policy v1."""
    base = F.col("bits").bitwiseAND(F.lit(mask(BASE_RULES))) != 0
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return _stored(spark, sf_dir).select("doc_id", *cols, base.alias("base_failed"), kept(F.col("bits"), "v1").alias("kept"), F.col("bits").alias("fail_bits"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, and what it alone rejects, from the stored ledger."""
    return ablation(_stored(spark, sf_dir), "v1")


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All policies over the stored ledger, against the labels."""
    return policy_table(_stored(spark, sf_dir), table(spark, sf_dir, "labels"))


#: DuckDB SQL for the query above.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         list_filter(string_split(t, chr(10)), lambda x: x <> '') AS nl
  FROM d
), grams AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), rep AS (
  SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(list_distinct(nl))::BIGINT AS n_lines,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS stutter, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS caps, len(regexp_extract_all(t, '!'))::BIGINT AS excl
  FROM w LEFT JOIN cov USING (r)
), b AS (
  SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (100 * n_symbols > 10 * n_words)::INT + 8 * (100 * n_dup_lines > 30 * (n_dup_lines + n_lines))::INT
    + 16 * (n_words > 0 AND word_chars > 15 * n_words)::INT + 32 * (n_words > 0 AND word_chars < 2 * n_words)::INT
    + 64 * (n_words > 0 AND 100 * caps > 50 * word_chars)::INT + 128 * (100 * excl > 20 * n_words)::INT + 256 * (100 * stutter > 25 * n_words)::INT)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 503) = 0 AS kept, fail_bits FROM b
"""
ABLATION_SQL = "WITH x AS (SELECT fail_bits & %d AS f FROM (%s)) " % (mask(POLICIES["v1"]), SQL) + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, count(*) FILTER (f & {1 << RULES[r]} <> 0) AS n_failed, count(*) FILTER (f = {1 << RULES[r]}) AS n_only, count(*) AS n_docs FROM x" for r in POLICIES["v1"]
)
POLICIES_SQL = f"WITH x AS (SELECT fail_bits, quality FROM ({SQL}) LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, count(*) AS n_docs, count(*) FILTER (fail_bits & {mask(r)} = 0) AS n_kept, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 1 AND fail_bits & {mask(r)} = 0) AS good_kept, "
    f"count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (quality = 0 AND fail_bits & {mask(r)} = 0) AS bad_kept FROM x"
    for p, r in POLICIES.items()
)
