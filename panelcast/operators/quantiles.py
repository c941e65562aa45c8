"""Exact quantiles over any number of rows.

The built-in exact percentile holds every distinct value of a group in one task.
Here groups are narrowed: values map to integers in the same order, counts per
leading bits find the cell holding the wanted rank, and only that cell is looked
at more finely. Each of the three passes reads the input anew and combines
map-side: counts of cells are shuffled, at most 2^22 of a group per pass, and
never the values themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MANTISSA = 52
_MIN_EXP, _MAX_EXP = -1022, 1023
# Bits dropped at each pass but the last: 64 = 20 + 22 + 22.
_COARSE, _MIDDLE = 44, 22


def ordered_long(x: Column) -> Column:
    """A double as a BIGINT that never reverses the order: exponent, mantissa, sign.

    Where log2 rounds across a power of two, the clipped mantissa lands on that
    power, so neighbours may share an image but never cross. Zero shares the cell
    of the denormals.
    """
    a = F.abs(x)
    exp = F.least(
        F.greatest(F.coalesce(F.floor(F.log2(a)), F.lit(_MIN_EXP)), F.lit(_MIN_EXP)),
        F.lit(_MAX_EXP),
    )
    scale = F.lit(float(2**_MANTISSA))
    mantissa = F.least(F.greatest(a / F.pow(F.lit(2.0), exp), F.lit(1.0)), F.lit(2.0))
    image = (exp - _MIN_EXP) * F.lit(2**_MANTISSA) + ((mantissa - 1) * scale).cast("bigint")
    return image * F.signum(x).cast("bigint")


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Linearly interpolated quantiles, long: (*by, column, prob, value).

    NULL and NaN are skipped; a column of only those has no row.
    """
    group = [*by, "column"]
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                for c in columns
            ]
        )
    )
    values = (
        df.select(*by, cells.alias("cell"))
        .select(*by, "cell.column", "cell.x")
        .where(F.col("x").isNotNull() & ~F.isnan("x"))
        .withColumns({"n": F.lit(1), "bits": ordered_long(F.col("x"))})
    )

    # Pass 1: count coarse cells, and place every wanted rank in one of them.
    coarse = values.groupBy(*group, F.shiftright("bits", _COARSE).alias("c1")).agg(
        F.sum("n").alias("n")
    )
    running = F.sum("n").over(Window.partitionBy(*group).orderBy("c1"))
    total = F.sum("n").over(Window.partitionBy(*group))
    coarse = coarse.withColumns({"upto": running, "total": total})
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("prob")) for i, p in enumerate(probs)])
    )
    position = (F.col("total") - 1) * F.col("want.prob")
    ends = F.explode(
        F.array(
            F.struct(F.lit("lo").alias("end"), F.floor(position).cast("bigint").alias("rank")),
            F.struct(F.lit("hi").alias("end"), F.ceil(position).cast("bigint").alias("rank")),
        )
    )
    ranks = (
        coarse.withColumn("want", wanted)
        .withColumn("at", ends)
        .withColumns({"rank": F.col("at.rank"), "before": F.col("upto") - F.col("n")})
        .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
        .select(
            *group,
            "c1",
            "at.end",
            F.col("want.prob").alias("prob"),
            F.col("want.i").alias("i"),
            (position - F.floor(position)).alias("frac"),
            (F.col("rank") - F.col("before")).alias("rank"),
        )
    )

    # Pass 2 and 3: the same inside the cells that hold a wanted rank.
    middle = F.shiftright("bits", _MIDDLE).alias("c2")
    ranks = _narrow(values, ranks, group, ("c1", _COARSE), "c2", middle, bool(by))
    ranks = _narrow(values, ranks, group, ("c2", _MIDDLE), "x", F.col("x"), bool(by))

    lo, hi = F.min("x"), F.max("x")
    return (
        ranks.groupBy(*group, "i", "prob")
        .agg((lo + (hi - lo) * F.max("frac")).alias("value"))
        .select(*group, "prob", "value")
    )


def _narrow(
    values: DataFrame,
    ranks: DataFrame,
    group: list[str],
    cell: tuple[str, int],
    finer_name: str,
    finer: Column,
    grouped: bool,
) -> DataFrame:
    """Count finer cells inside the one each rank lies in, and move the rank into its own.

    Without groups the ranks are two per column and quantile, so they are
    broadcast; with groups their number is open, and Spark decides.
    """
    name, shift = cell
    on = [*group, name]
    wanted = ranks.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    inside = values.withColumn(name, F.shiftright("bits", shift)).join(
        wanted if grouped else F.broadcast(wanted), same
    )
    one_rank = [*group, "i", "end", "prob", "frac", "rank"]
    counted = inside.groupBy(*one_rank, finer).agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group, "i", "end").orderBy(finer_name))
    before = F.col("upto") - F.col("n")
    return (
        counted.withColumn("upto", upto)
        .where((F.col("rank") >= before) & (F.col("rank") < F.col("upto")))
        .select(
            *group, finer_name, "i", "end", "prob", "frac", (F.col("rank") - before).alias("rank")
        )
    )


def quantiles_wide(
    df: DataFrame, columns: Sequence[str], named: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per (*by, column), one output column per named quantile."""
    long = exact_quantiles(df, columns, list(named.values()), by)
    return long.groupBy(*by, "column").agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in named.items()]
    )
