"""Rounding as Python does it: half to even of the binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pyfmt(x: Column, places: int) -> Column:
    """Text with a fixed number of decimal places. The JVM goes by a number's shortest digits, so 5e-05, which is slightly more
    than a tie in binary, is 0.0000 with four places, and not 0.0001."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def pyround(x: Column, places: int) -> Column:
    """A number is scaled and rounded; only near a tie, where scaling may hide on which side the binary value lies, and for
    large numbers does the text decide."""
    scale = float(10**places)
    scaled = x.cast("double") * F.lit(scale)
    clear = (F.abs(x) < 1e9) & (F.abs(F.abs(scaled) % 1 - 0.5) > 1e-5)
    return F.when(clear, F.rint(scaled) / F.lit(scale)).otherwise(pyfmt(x, places).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
