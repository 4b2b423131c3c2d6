"""Scalar functions on columns; all but the bits of floats stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..model import Dtype
from .whole import floor_div

NS = 1_000_000_000


def c_fixed(value: Column, precision: int) -> Column:
    """A number with so many decimals, rounded half to even on its binary value, without separators (``printf("%.*f")``)."""
    x = value.cast("double")
    text = F.replace(F.format_number(x, precision), F.lit(","), F.lit(""))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(text)


@pandas_udf(LongType())
def float_bits(value: pd.Series) -> pd.Series:
    """The 32 bits of each float as an unsigned number; the only function here that needs Python."""
    return pd.Series(value.to_numpy(np.float32).view(np.uint32).astype(np.int64))


def hex32(bits: Column) -> Column:
    """``0x`` and eight hexadecimal digits of the low 32 bits."""
    return F.concat(F.lit("0x"), F.lpad(F.hex(bits.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def bits32(bits: Column) -> Column:
    """``0b`` and the low 32 bits."""
    return F.concat(F.lit("0b"), F.lpad(F.bin(bits.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 32, "0"))


def number_text(value: Column, dtype: Dtype, fmt: str = "decimal") -> Column:
    """A sample as text: ``decimal``, ``scientific`` (floats only, else decimal), ``hex`` or ``binary``."""
    if fmt in ("hex", "binary"):
        bits = float_bits(value.cast("float")) if dtype is Dtype.FLOAT else value
        return hex32(bits) if fmt == "hex" else bits32(bits)
    if dtype is not Dtype.FLOAT:
        return value.cast("long").cast("string")
    return F.format_string("%e", value.cast("double")) if fmt == "scientific" else c_fixed(value, 6)


def narrow(value: Column, dtype: Dtype) -> Column:
    """A double as a sample type; fractions of integers are cut, and what does not fit is null instead of an ANSI error."""
    x = value.cast("double")
    if dtype is Dtype.FLOAT:
        return x.cast("float")
    low, high = (-(2**31), 2**31 - 1) if dtype is Dtype.I32 else (0, 2**32 - 1)
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when((whole >= low) & (whole <= high), whole).cast(dtype.spark)


def human_time(t_ns: Column) -> Column:
    """Nanoseconds in the largest unit that is not zero; ``---`` for zero."""
    us, ms, s = (floor_div(t_ns, n) for n in (1000, 1_000_000, NS))
    part = lambda big, small: F.format_string("%d.%03d", big, small % 1000)
    return (
        F.when(t_ns == 0, "---")
        .when(s > 0, F.concat(part(s, ms), F.lit("s")))
        .when(ms > 0, F.concat(part(ms, us), F.lit("ms")))
        .when(us > 0, F.concat(us.cast("string"), F.lit("μs")))
        .otherwise(F.concat(t_ns.cast("string"), F.lit("ns")))
    )


def now_ns() -> Column:
    """The time of the query in nanoseconds, to the microsecond."""
    return F.unix_micros(F.current_timestamp()) * 1000


def split_time(t_ns: Column) -> Column:
    """Seconds and nanoseconds of the second, for times before the epoch too."""
    rest = F.pmod(t_ns, F.lit(NS))
    return F.struct(floor_div(t_ns, NS).alias("sec"), rest.alias("nsec"))


def period_to_rate(period_ns: Column) -> Column:
    """Whole samples a second of a period in nanoseconds; 0 stands for unknown both ways."""
    return F.when(period_ns == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", F.lit(NS).cast("long"), F.when(period_ns != 0, period_ns)))


def rate_to_period(rate_hz: Column) -> Column:
    """Nanoseconds of a sample at a whole rate."""
    return period_to_rate(rate_hz)


def file_name(label: Column, suffix: str = ".txt") -> Column:
    """A label made safe as a file name: each of ``/ \\ : * ? " < > |`` and blank becomes ``_``."""
    return F.concat(F.translate(label, '/\\:*?"<>| ', "__________"), F.lit(suffix))
