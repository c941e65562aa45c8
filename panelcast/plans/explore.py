"""The tables of an exploratory report on the cleaned data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators import profile, rollup
from panelcast.spec import FLAGS, MEASURES


def _of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def describe(df: DataFrame) -> dict[str, DataFrame]:
    """Summaries of the numeric, text and date columns; a kind without columns is left out."""
    kinds = {
        "numeric": (_of_type(df, T.NumericType), profile.column_summary),
        "text": (_of_type(df, T.StringType), profile.text_summary),
        "date": (_of_type(df, T.DateType), profile.date_summary),
    }
    return {kind: summary(df, columns) for kind, (columns, summary) in kinds.items() if columns}


def explore(
    store: DataFrame, products: DataFrame, transactions: DataFrame
) -> dict[str, DataFrame]:
    """Summaries, outliers, price ranges, and promotion effects per category."""
    tables = {
        f"{name}_{kind}": table
        for name, df in (("store", store), ("products", products), ("transactions", transactions))
        for kind, table in describe(df).items()
    }
    measures = [c for c in MEASURES if c in transactions.columns]
    flags = profile.outlier_flags(transactions, columns=measures)
    weekly = rollup.category_weekly(transactions, products)
    numbers = ("units", "visits", "base_price")
    by = ["category"]
    return tables | {
        "outliers": profile.outlier_counts(flags),
        "price_range": profile.price_range(transactions),
        "category_weekly": weekly,
        "product_overview": rollup.product_long(weekly),
        "promotion_overview": rollup.promotion_long(weekly),
        "correlation": profile.pair_correlations(weekly, numbers, by),
        "correlation_by_flag": profile.pair_correlations_by_flag(weekly, numbers, FLAGS, by),
        "five_numbers": profile.five_numbers(weekly, numbers, FLAGS, by),
        "flag_crosstab": profile.flag_crosstab(weekly, FLAGS, by),
        "correlation_overall": profile.pair_correlations(
            transactions.select(*[F.col(c).cast("double") for c in measures]), measures
        ),
    }
