"""Column summaries, outliers, correlations, histograms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.rows import strict
from panelcast.operators.quantiles import exact_quantiles, ordered_long, quantiles_wide
from panelcast.spec import FLAGS, MEASURES

FENCE = 3.0


def across(
    columns: Sequence[str], fn: Callable[[Column], Column], name: str = "{col}"
) -> list[Column]:
    """One expression over many columns, each named by the pattern."""
    return [fn(F.col(c)).alias(name.format(col=c)) for c in columns]


def _long_stats(df: DataFrame, columns: Sequence[str], stats: dict[str, Callable], by=()) -> DataFrame:
    """All statistics of all columns in one aggregate, then one row per column."""
    aggs = [fn(F.col(c)).alias(f"{c}|{s}") for c in columns for s, fn in stats.items()]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    *[F.col(f"`{c}|{s}`").alias(s) for s in stats],
                )
                for c in columns
            ]
        )
    )
    return wide.select(*by, rows.alias("r")).select(*by, "r.*")


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count, complete rate, mean, sd, min, max (2 decimals) and quartiles."""
    stats = {
        "n_missing": lambda x: F.count_if(x.isNull()),
        "complete_rate": lambda x: F.count(x) / F.count(F.lit(1)),
        "mean": lambda x: F.round(F.avg(x), 2),
        "sd": lambda x: F.round(F.stddev_samp(x), 2),
        "min": lambda x: F.round(F.min(x).cast("double"), 2),
        "max": lambda x: F.round(F.max(x).cast("double"), 2),
    }
    quartiles = quantiles_wide(df, columns, {"p25": 0.25, "p75": 0.75})
    return _long_stats(df, columns, stats).join(quartiles, "column", "left")


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing, empty, distinct and length range of text columns."""
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    return _value_counts(df, columns).groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        (F.coalesce(F.sum(known), F.lit(0)) / F.sum("n")).alias("complete_rate"),
        F.coalesce(F.sum(F.when(F.col("value") == "", F.col("n"))), F.lit(0)).alias("n_empty"),
        F.count("value").alias("n_unique"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
    )


def date_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _value_counts(df, columns).groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_unique"),
        F.min("value").alias("min_date"),
        F.max("value").alias("max_date"),
    )


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): values are counted map-side, so distinct counts need no expanded rows."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    return df.select(cell.alias("c")).groupBy("c.column", "c.value").agg(F.count(F.lit(1)).alias("n"))


def price_range(df: DataFrame, by: str = "upc_id", value: str = "price") -> DataFrame:
    x = F.col(value)
    return df.groupBy(by).agg(
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
    )


def outlier_fences(
    df: DataFrame, columns: Sequence[str] = MEASURES, k: float = FENCE, approx: bool = False
) -> DataFrame:
    """One row: lower and upper fence of every column, k interquartile ranges out."""
    if approx:
        q = {c: F.percentile_approx(c, [0.25, 0.75], 10000) for c in columns}
        quartiles = df.agg(*[q[c].alias(c) for c in columns])
        lo = {c: F.col(c)[0].cast("double") for c in columns}
        hi = {c: F.col(c)[1].cast("double") for c in columns}
    else:
        long = exact_quantiles(df, columns, [0.25, 0.75])

        def pick(c: str, p: float) -> Column:
            return F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value")))

        quartiles = long.agg(
            *[pick(c, 0.25).alias(f"{c}_q1") for c in columns],
            *[pick(c, 0.75).alias(f"{c}_q3") for c in columns],
        )
        lo = {c: F.col(f"{c}_q1") for c in columns}
        hi = {c: F.col(f"{c}_q3") for c in columns}
    spread = {c: F.lit(float(k)) * (hi[c] - lo[c]) for c in columns}
    return quartiles.select(
        *[(lo[c] - spread[c]).alias(f"{c}_lo") for c in columns],
        *[(hi[c] + spread[c]).alias(f"{c}_hi") for c in columns],
    )


def outlier_flags(
    df: DataFrame,
    row_id: Sequence[str] = ("week", "store_id", "upc_id"),
    columns: Sequence[str] = MEASURES,
    k: float = FENCE,
    approx: bool = False,
) -> DataFrame:
    """Per row and column: is the value outside the column's fences? NULL stays NULL.

    The fences are one row by construction and enter as a scalar subquery.
    """
    fences = outlier_fences(df, columns, k, approx)
    one = fences.select(F.struct(*fences.columns).alias("f")).scalar()
    fenced = df.select(*row_id, *columns, one.alias("_f"))
    flags = [
        ((F.col(c) < F.col(f"_f.{c}_lo")) | (F.col(c) > F.col(f"_f.{c}_hi"))).alias(f"outlier_{c}")
        for c in columns
    ]
    return fenced.select(*row_id, *flags)


def outlier_counts(flags: DataFrame, strict_nulls: bool = False) -> DataFrame:
    """Sum of every outlier flag. With `strict_nulls`, a NULL flag makes the count NULL."""
    columns = [c for c in flags.columns if "outlier" in c]

    def total(x: Column) -> Column:
        n = F.coalesce(F.sum(x.cast("bigint")), F.lit(0).cast("bigint"))
        return strict(n, x) if strict_nulls else n

    return flags.agg(*across(columns, total))


def pair_correlations(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Pearson correlation of every column pair, long, in one aggregate per group."""
    pairs = list(combinations(columns, 2))
    aggs = [F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("corr")
                )
                for a, b in pairs
            ]
        )
    )
    return wide.select(*by, rows.alias("r")).select(*by, "r.*")


def pair_correlations_by_flag(
    df: DataFrame,
    columns: Sequence[str],
    flags: Sequence[str] = FLAGS,
    by: Sequence[str] = (),
) -> DataFrame:
    """The same within each level of each flag (True / False)."""
    long = _flag_levels(df, columns, flags, by)
    return pair_correlations(long, columns, [*by, "flag", "level"])


def five_numbers(
    df: DataFrame, columns: Sequence[str], flags: Sequence[str] = FLAGS, by: Sequence[str] = ()
) -> DataFrame:
    """Minimum, quartiles, maximum of every column at each level of each flag."""
    named = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return quantiles_wide(
        _flag_levels(df, columns, flags, by), columns, named, [*by, "flag", "level"]
    )


def flag_crosstab(
    df: DataFrame, flags: Sequence[str] = FLAGS, by: Sequence[str] = ()
) -> DataFrame:
    """Rows per combination of levels, for every pair of flags.

    One grouping over all flags counts the combinations; the pairs are then sums
    over at most a few dozen rows per group.
    """
    levels = df.select(*by, *[true_false(F.col(f)).alias(f) for f in flags])
    counts = levels.groupBy(*by, *flags).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("x"),
                    F.lit(b).alias("y"),
                    F.col(a).alias("x_level"),
                    F.col(b).alias("y_level"),
                )
                for a, b in combinations(flags, 2)
            ]
        )
    )
    return (
        counts.select(*by, "n", pairs.alias("p"))
        .groupBy(*by, "p.x", "p.y", "p.x_level", "p.y_level")
        .agg(F.sum("n").alias("n"))
    )


def true_false(flag: Column) -> Column:
    return F.when(flag == 1, "True").when(flag.isNotNull(), "False")


def _flag_levels(
    df: DataFrame, columns: Sequence[str], flags: Sequence[str], by: Sequence[str]
) -> DataFrame:
    levels = F.explode(
        F.array(
            *[F.struct(F.lit(f).alias("flag"), true_false(F.col(f)).alias("level")) for f in flags]
        )
    )
    return df.select(*by, *columns, levels.alias("l")).select(*by, *columns, "l.flag", "l.level")


#: Bits of a value's image that a cell of the histogram's sketch leaves out: 4,096 cells between powers of two.
CELL_BITS = 40


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """Equal-width bins between each group's minimum and maximum; empty bins are not listed.

    The maximum falls in the last bin; a group of one value has one bin, and rows without a group
    are a group. A first pass counts cells of neighbouring values, combined before they move: they
    give the ends of every group, and all counts but those of the cells that a bin's edge cuts (fewer
    than `bins` in a group). Only the rows of those are looked at again. So neither the number of
    groups nor the size of one matters: no group is gathered and no table of groups is collected.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    known = known.withColumn("_cell", F.shiftright(ordered_long(F.col("_x")), CELL_BITS))
    group = Window.partitionBy(*by)
    cells = known.groupBy(*by, "_cell").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count(F.lit(1)).alias("n"))
    cells = cells.withColumns({"lo": F.min("_low").over(group), "hi": F.max("_high").over(group)})
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)

    def bin_of(x: Column) -> Column:
        return F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
            F.least(F.floor((x - F.col("lo")) / width).cast("int") + 1, F.lit(bins))
        )

    first, last = bin_of(F.col("_low")), bin_of(F.col("_high"))
    whole = cells.where(first == last).select(*by, "lo", "hi", first.alias("bin"), "n")
    cut = cells.where(first != last).select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_cell").alias("_of_cell"), "lo", "hi")
    same = F.col("_cell") == F.col("_of_cell")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    again = known.join(cut, same).select(*by, "lo", "hi", bin_of(F.col("_x")).alias("bin"), F.lit(1).cast("long").alias("n"))
    counts = whole.unionByName(again).groupBy(*by, "lo", "hi", "bin").agg(F.sum("n").alias("n"))
    return counts.select(
        *by,
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_start"),
        (F.col("lo") + F.col("bin") * width).alias("bin_end"),
        "n",
    )
