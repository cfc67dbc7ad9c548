from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def minor_units(value: Column, scale: int = 2) -> Column:
    """Money as a whole number of minor units: sums do not depend on row order."""
    return F.round(value.cast("double") * F.lit(float(10**scale))).cast("long")


def exact_minor_units(df: DataFrame, name: str, scale: int = 2) -> Column:
    """``minor_units`` of a column of ``df``; decimals and whole numbers are converted digit by digit, not as doubles."""
    value, kind = F.col(name), df.schema[name].dataType
    if not isinstance(kind, (T.DecimalType, T.IntegralType)):
        return minor_units(value, scale)
    digits = F.round(value.cast("decimal(38,0)") if isinstance(kind, T.IntegralType) else value, scale)
    return F.replace(digits.cast(f"decimal(38,{scale})").cast("string"), F.lit("."), F.lit("")).cast("long")


def half_even_share(count: Column, total: Column, n: Column) -> Column:
    """round-half-even(count * n / total) in whole numbers."""
    product = count.cast("decimal(19,0)") * n.cast("decimal(18,0)")
    quotient = exact_div(product, total)
    twice = (product % total.cast("decimal(19,0)")) * F.lit(2)
    tie_up = (twice == total) & (quotient % 2 == 1)
    return (quotient + ((twice > total) | tie_up).cast("int")).cast("long")


def wide_product(a: Column, b: Column) -> Column:
    """a * b of two 64-bit whole numbers, without overflow."""
    return a.cast("decimal(19,0)") * b.cast("decimal(18,0)")


def exact_div(a: Column, b: Column) -> Column:
    """Whole-number quotient as bigint; raises if it does not fit."""
    return F.call_function("div", a, b.cast("decimal(19,0)"))


def ordered_bucket(x: Column, per_octave: int = 32) -> Column:
    """Coarse integer that never decreases when ``x`` grows: sign and binary logarithm.

    At most ~70,000 distinct values whatever the data, so counting rows per bucket
    is a small aggregate from which order statistics are located.
    """
    magnitude = F.greatest(F.abs(x), F.lit(2.0**-60))
    octave = F.floor(F.log2(F.least(magnitude, F.lit(1e308))) * per_octave) + F.lit(60 * per_octave + 1)
    return F.when(F.abs(x) <= F.lit(2.0**-60), F.lit(0).cast("long")).otherwise(
        F.when(x < 0, -octave).otherwise(octave).cast("long")
    )
