"""Product sizes such as `500 ML` or `12 OZ` as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Millilitres per litre; grams per carat and per ounce (fixed values).
ML_PER_LT = 1000.0
GRAMS_PER_CARAT = 0.2
GRAMS_PER_OZ = 28.349523125


def _amount(size: Column) -> Column:
    return F.split(size, " ")[0].try_cast("double")


def _unit(size: Column) -> Column:
    return F.lower(F.try_element_at(F.split(size, " "), F.lit(2)))


def volume_ml(size: Column) -> Column:
    factor = F.when(_unit(size) == "lt", ML_PER_LT).when(_unit(size) == "ml", 1.0)
    return F.when(size.rlike("LT|ML"), _amount(size) * factor)


def mass_oz(size: Column, count_as_mass: bool = True) -> Column:
    """A count (CT) is read as carats unless `count_as_mass` is off, then it has no mass."""
    carat = GRAMS_PER_CARAT / GRAMS_PER_OZ
    factor = F.when(_unit(size) == "oz", 1.0)
    if count_as_mass:
        factor = factor.when(_unit(size) == "ct", carat)
    return F.when(size.rlike("OZ|CT"), _amount(size) * factor)


def size_is_count(size: Column) -> Column:
    return F.coalesce(_unit(size) == "ct", F.lit(False))
