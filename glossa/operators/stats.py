"""Agreement, tallies, ranks and timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossa.functions.text import norm_best, tied_systems


def mean_p95(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and nearest-rank 95th percentile of the values that are numbers."""
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean_s"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95_s"))


def kappa(pairs: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """n, percent_agreement and Cohen's kappa per group, from the confusion table.

    Null pairs are left out. One category alone gives 1; chance agreement of 1 gives null.
    """
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("c"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))).alias("m"))
    margins = sides.groupBy(*by, "m.c").agg((F.sum("m.x") * F.sum("m.y")).alias("xy")).groupBy(*by).agg(F.sum("xy").alias("xy"), F.count(F.lit(1)).alias("classes"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    joined = totals.join(margins, list(by)) if by else totals.crossJoin(margins)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    value = F.when(F.col("classes") == 1, 1.0).when(F.abs(1 - pe) < 1e-12, None).otherwise((po - pe) / (1 - pe))
    return joined.select(*by, "n", (100 * po).alias("percent_agreement"), value.alias("kappa"))


def long_pairs(raters: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(field, a, b): one row per rater pair and field."""
    items = [F.struct(F.lit(k).alias("field"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b")) for k, (x, y) in fields.items()]
    return raters.select(F.explode(F.array(*items)).alias("p")).select("p.*")


def adjudicate(d: Column, n: Column, llm: Column, note: Column) -> Column:
    """(label, rule): agreement; a noted tie decided by the model, then by N; the model; N."""
    a, b, c, tied = norm_best(d), norm_best(n), norm_best(llm), tied_systems(note)
    rule = F.when(a == b, "consensus").when(F.array_contains(tied, c), "tie_break_llm").when(F.array_contains(tied, b), "tie_break_n").when(c != "unknown", "llm_reference").otherwise("n_fallback")
    label = F.when(rule == "consensus", a).when(rule.isin("tie_break_llm", "llm_reference"), c).otherwise(b)
    return F.struct(label.alias("label"), rule.alias("rule"))


def needs_adjudication(rule: Column, note: Column) -> Column:
    return (rule != "consensus") | (F.size(tied_systems(note)) > 0)


def merge_best(d: Column, n: Column) -> Column:
    """The common best system; null if the raters differ."""
    return F.when(norm_best(d) == norm_best(n), norm_best(d))


def tally(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """(value, votes, pct): counts with whole per cent, halves to even; missing values are UNKNOWN."""
    counts = df.groupBy(*by, F.coalesce(F.nullif(F.upper(F.trim(value)), F.lit("")), F.lit("UNKNOWN")).alias("value")).agg(F.count(F.lit(1)).alias("votes"))
    total = F.sum("votes").over(Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]))
    return counts.withColumn("pct", F.bround(100 * F.col("votes") / total).cast("int"))


def average_ranks(df: DataFrame, ranking: str) -> DataFrame:
    """(system, avg_rank, n) of comma-separated rankings; blanks are dropped before places are counted."""
    names = F.filter(F.transform(F.split(F.upper(ranking), ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(F.posexplode(names).alias("pos", "system")).groupBy("system").agg(F.avg(F.col("pos") + 1).alias("avg_rank"), F.count(F.lit(1)).alias("n"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, by the digest of seed and key: the same in any engine and any partitioning."""
    mark = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_mark", mark).orderBy("_mark", key).limit(n).drop("_mark")


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0..1; a constant one becomes 0. Extremes are one row, joined back."""
    ends = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    wide = df.crossJoin(F.broadcast(ends))  # one row
    span = {c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise(F.col(f"hi_{c}") - F.col(f"lo_{c}")) for c in columns}
    return wide.select(*[((F.col(c) - F.col(f"lo_{c}")) / span[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def collapsed(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(column).alias("n"), ((F.count(column) >= 2) & (F.max(column) - F.min(column) < 1e-4)).alias("collapsed"))


def matrix(scores: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Scores as a table with holes; the columns are given, so no pass is needed to find them."""
    return scores.groupBy(row).pivot(column, columns).agg(F.first(value))


def first_known(df: DataFrame, by: str, value: str, position: str) -> DataFrame:
    """(by, value): of each group the first value, by position, that is neither null nor NaN; null if there is none."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.groupBy(by).agg(F.min_by(F.when(known, F.col(value)), F.when(known, F.col(position))).alias(value))


def override(old: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """``old`` with values of ``fresh`` where it has one, and ``renewed``, whether it has."""
    new = fresh.select(key, F.col(value).alias("_new"))
    return old.join(new, key, "left").withColumn("renewed", F.col("_new").isNotNull()).withColumn(value, F.coalesce("_new", value)).drop("_new")
