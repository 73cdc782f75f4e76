"""Repeated line runs, found with a suffix array over line ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import cut, fresh, table, words_of


def _with_word(line: Column) -> Column:
    return F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0


def _has_words(line: Column, n: int) -> Column:
    """Whether a line has ``n`` words or more. Single spaces between words are counted; only lines
    with other white space are split."""
    plain = F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))
    spaces = F.length(plain) - F.length(F.translate(plain, " ", ""))
    return F.when(spaces < n - 1, False).when(F.instr(plain, "  ") == 0, True).otherwise(F.size(words_of(line)) >= n)


HERE = ("doc", "tie", "at")
FIRST = ("first_doc", "first_tie", "first_at")


def _classes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Classes of ``keys`` that occur twice or more, each with its first place and a rank.

    Ranks grow in the order of the keys. The sort is a range exchange over distinct keys, so no
    key is hot; ranks are read off the checkpointed partitions, which are the same for every
    later reader.
    """
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*HERE)).alias("first")).filter("n >= 2")
    found = found.select(*keys, *[F.col(f"first.{c}").alias(f) for c, f in zip(HERE, FIRST, strict=True)])
    return cut(found.orderBy(*keys)).withColumn("longer", F.monotonically_increasing_id())


#: Tables of at most so many narrow rows go through a step in one task, without an exchange.
SMALL_ROWS = 20_000


def _gathered(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows in one partition if it is small: deep levels are, and an exchange of them
    would cost tasks and move next to nothing."""
    return df.coalesce(1) if n <= SMALL_ROWS else df


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """Intervals of the suffix array over line ids by depth, until every suffix is alone.

    ``lines``: doc, tie (together one document), at (0, 1, ... inside it), h1, h2 (the line's
    128-bit hash). Distributed prefix doubling: line ids rank suffixes by one line; the pair of
    a suffix's rank and the rank 2**k lines further ranks it by 2**(k+1). Level k holds the
    suffixes (doc, tie, at, rank, and the first place of their class) that share their first
    2**k lines with another: a class of equal rank is an interval of the suffix array whose
    longest common prefix is 2**k lines at least. Suffixes alone in their class share no longer
    prefix with any other and leave, so each level is smaller, and their number grows with the
    logarithm of the longest repeat.
    """
    rows, keys = lines, ["h1", "h2"]
    levels: list[DataFrame] = []
    while True:
        level = cut(rows.join(_classes(rows, keys), keys).select(*HERE, F.col("longer").alias("rank"), *FIRST))
        n = level.count()
        if not n:
            return levels
        level = _gathered(level, n)
        levels.append(level)
        step = 1 << (len(levels) - 1)
        ahead = F.min("rank").over(Window.partitionBy("doc", "tie").orderBy("at").rangeBetween(step, step))
        rows, keys = level.select(*HERE, "rank", ahead.alias("next")).filter("next is not null"), ["rank", "next"]


def _is_later() -> Column:
    return ~F.struct(*HERE).eqNullSafe(F.struct(*[F.col(f).alias(c) for c, f in zip(HERE, FIRST, strict=True)]))


def maximal_runs(levels: list[DataFrame], run: int) -> DataFrame | None:
    """Rows (doc, tie, at, length, first_doc, first_tie, first_at): the maximal later copies of line runs.

    A suffix that is no first copy at some depth takes the first copy of its deepest such interval
    as its source; their longest common prefix is found by descending the levels from there, and
    is the run's length. Runs inside a longer run of their document are left out. A suffix that
    only follows its predecessor along the same source starts no run of its own. Runs are at
    least ``run`` lines, a power of two; None if no level is that deep.
    """
    if run < 1 or run & (run - 1):
        raise ValueError("run must be a power of two")
    low = run.bit_length() - 1
    copies = [x.filter(_is_later()).select(*HERE, F.lit(k).alias("k"), *FIRST) for k, x in enumerate(levels) if k >= low]
    if not copies:
        return None
    later = reduce(DataFrame.unionByName, copies)
    deepest = later.groupBy(*HERE).agg(F.max(F.struct("k", *FIRST)).alias("d")).select(*HERE, "d.*")
    order = Window.partitionBy("doc", "tie").orderBy("at")
    before = lambda c: F.lag(c).over(order)
    follows = (before("at") == F.col("at") - 1) & before("first_doc").eqNullSafe(F.col("first_doc")) & (before("first_tie") == F.col("first_tie")) & (before("first_at") == F.col("first_at") - 1) & (before("k") >= F.col("k"))
    starts = deepest.withColumn("follows", F.coalesce(follows, F.lit(False))).filter("not follows").drop("follows")
    starts = cut(starts.withColumn("length", F.expr("shiftleft(1, k)")))
    starts = _gathered(starts, starts.count())
    for k in reversed(range(len(levels) - 1)):
        here = levels[k].select(F.col("doc").alias("a_doc"), F.col("tie").alias("a_tie"), F.col("at").alias("a_at"), F.col("rank").alias("a"))
        there = levels[k].select(F.col("doc").alias("b_doc"), F.col("tie").alias("b_tie"), F.col("at").alias("b_at"), F.col("rank").alias("b"))
        # a source found at this depth or above shares no more lines than that here: its key is null
        goes_on = F.when(F.col("k") > k, F.col("length"))
        found = starts.join(here, F.col("doc").eqNullSafe(F.col("a_doc")) & (F.col("tie") == F.col("a_tie")) & (F.col("at") + goes_on == F.col("a_at")), "left")
        found = found.join(there, F.col("first_doc").eqNullSafe(F.col("b_doc")) & (F.col("first_tie") == F.col("b_tie")) & (F.col("first_at") + goes_on == F.col("b_at")), "left")
        found = found.withColumn("length", F.col("length") + F.when(F.col("a") == F.col("b"), 1 << k).otherwise(0))
        starts = found.select(*starts.columns)
    reach = F.max(F.col("at") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = starts.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("at") + F.col("length") > F.col("reach")))
    return runs.select(*HERE, "length", *FIRST)


def _lines(docs: DataFrame, id_column: str, text_column: str, alone: int | None) -> DataFrame:
    """One row per line with a word; rows that repeat id and text are one document."""
    text = F.col(text_column)
    worded = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _with_word)
    lines = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text).alias("tie"), F.posexplode(worded).alias("at", "line"))
    is_long = F.lit(False) if alone is None else _has_words(F.col("line"), alone)
    return cut(lines.select(*HERE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), is_long.alias("long")).distinct())


def repeated_runs(docs: DataFrame, run: int = 2, alone: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Later copies of line runs: doc, tie, at, length, first_doc, first_tie, first_at (lines with a word, counted from 0).

    With ``alone``, single lines of that many words or more that no longer run holds are runs too.
    Null and empty texts have no lines; an empty table has no runs.
    """
    lines = _lines(docs, id_column, text_column, alone)
    levels = suffix_levels(lines)
    runs = maximal_runs(levels, run)
    if runs is None:
        kinds = {f.name: f.dataType for f in lines.schema}
        runs = lines.filter("false").select(*HERE, F.lit(1).alias("length"), *[F.lit(None).cast(kinds[c]).alias(f) for c, f in zip(HERE, FIRST, strict=True)])
    if alone is None or not levels:
        return cut(runs)
    single = levels[0].filter(_is_later()).join(lines.filter("long").select(*[F.col(c).alias(f"l_{c}") for c in HERE]), F.col("doc").eqNullSafe(F.col("l_doc")) & (F.col("tie") == F.col("l_tie")) & (F.col("at") == F.col("l_at")), "left_semi")
    both = runs.unionByName(single.select(*HERE, F.lit(1).alias("length"), *FIRST))
    order = Window.partitionBy("doc", "tie").orderBy("at", F.desc("length"))
    reach = F.max(F.col("at") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("at") + F.col("length") > F.col("reach")))
    return cut(both.drop("reach"))


def dedup_lines(docs: DataFrame, run: int = 2, alone: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without later copies of line runs, plus ``n_lines`` and ``n_deleted``.

    A line goes if it lies in a maximal run of ``run`` lines or more that also stands earlier: in a
    document with a smaller id (null first; equal ids by a hash of the text), or further up in
    the same one. Its first copy stays. With ``alone``, a line of that many words or more is a
    run by itself. Lines without a word are no part of a run and stay. Built-in functions only.

    Null texts stay null with 0 lines; empty texts stay empty; rows that repeat id and text are
    one document and change alike; an empty table gives an empty table; other columns are kept
    whatever their names, but ``n_lines`` and ``n_deleted`` take underscores if those are taken.
    """
    text, doc = F.col(text_column), F.col(id_column)
    worded = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _with_word)
    runs = repeated_runs(docs, run, alone, id_column, text_column)
    gone = runs.select("doc", "tie", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("at"))
    # a document's own line numbers: no longer than the document
    tie, dead, gone_doc, gone_tie = (fresh(docs, f"__{c}") for c in ("tie", "gone", "gone_doc", "gone_tie"))
    gone = gone.groupBy(F.col("doc").alias(gone_doc), F.col("tie").alias(gone_tie)).agg(F.collect_set("at").alias(dead))
    marked = docs.withColumn(tie, F.xxhash64(text))
    joined = marked.join(gone, doc.eqNullSafe(F.col(gone_doc)) & (F.col(tie) == F.col(gone_tie)), "left")
    all_lines = F.split(text, "\n")

    def rebuilt(b: Column) -> Column:
        dead_raw = F.transform(b["gone"], lambda k: F.get(b["numbers"], k))
        stay = F.array_except(F.sequence(F.lit(0), F.size(b["lines"]) - 1), dead_raw)
        return F.array_join(F.transform(stay, lambda i: F.get(b["lines"], i)), "\n")

    bound = F.transform(F.array(all_lines), lambda x: F.struct(x.alias("lines"), F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: _with_word(F.get(x, i))).alias("numbers"), F.col(dead).alias("gone")))
    new = F.when(F.col(dead).isNull(), text).otherwise(F.get(F.transform(bound, rebuilt), F.lit(0)))
    n_lines, n_deleted = fresh(docs, "n_lines"), fresh(docs, "n_deleted")
    out = joined.withColumns({n_lines: F.size(worded).cast("long"), n_deleted: F.coalesce(F.size(dead), F.lit(0)).cast("long")})
    return out.withColumn(text_column, new).select(*docs.columns, n_lines, n_deleted)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of runs of two lines or more, or of lines of ten words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, run=2, alone=10).select("doc_id", "n_lines", "n_deleted", "text")


#: DuckDB SQL for the query above.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), x AS (
  SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d
), w AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), p AS (
  SELECT a.r, a.doc_id, a.k, a.line AS a, b.line AS b FROM w a JOIN w b ON a.r = b.r AND b.k = a.k + 1
), later AS (
  SELECT r, k FROM p QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY doc_id, k) > 1
), single AS (
  SELECT r, k FROM w WHERE len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 10
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, k) > 1
), dead AS (
  SELECT DISTINCT r, k FROM (SELECT r, k FROM later UNION ALL SELECT r, k + 1 FROM later UNION ALL SELECT r, k FROM single)
), gone AS (
  SELECT w.r, w.i FROM w JOIN dead ON w.r = dead.r AND w.k = dead.k
), kept AS (
  SELECT x.r, string_agg(x.line, chr(10) ORDER BY x.i) AS text
  FROM x LEFT JOIN gone ON x.r = gone.r AND x.i = gone.i WHERE gone.i IS NULL GROUP BY x.r
)
SELECT d.doc_id, (SELECT count(*) FROM w WHERE w.r = d.r)::BIGINT AS n_lines,
       (SELECT count(*) FROM dead WHERE dead.r = d.r)::BIGINT AS n_deleted,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept ON d.r = kept.r
"""
