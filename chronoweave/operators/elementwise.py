"""Element-wise operators: maps, casts, passthrough; stateful maps as folds over a series.

Maps are column expressions, so a chain of them is one projection in the plan.  Each stage rounds to the sample type, as
a chain of buffers would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import narrow
from ..model import Dtype, StreamError


def map_samples(df: DataFrame, *functions: Callable[[Column], Column], dtype: Dtype = Dtype.FLOAT) -> DataFrame:
    """Applies functions of a column to ``value`` in turn."""
    value = F.col("value")
    for f in functions:
        value = f(value).cast(dtype.spark)
    return df.withColumn("value", value)


def scale(k: float) -> Callable[[Column], Column]:
    return lambda x: x.cast("double") * float(k)


def offset(c: float) -> Callable[[Column], Column]:
    return lambda x: x.cast("double") + float(c)


def identity(x: Column) -> Column:
    return x


def failing(message: str = "map failed") -> Callable[[Column], Column]:
    """A map that fails on its first sample."""
    return lambda x: F.when(x.isNotNull() | x.isNull(), F.raise_error(F.lit(message))).otherwise(x)


def map_blocks(df: DataFrame, f: Callable, dtype: Dtype = Dtype.FLOAT) -> DataFrame:
    """Applies an opaque function of a numpy array to ``value``, a block at a time through Arrow."""
    at, schema = df.columns.index("value"), df.schema
    kind = {Dtype.FLOAT: pa.float32(), Dtype.I32: pa.int32(), Dtype.U32: pa.int64()}[dtype]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch.column(at).to_numpy(zero_copy_only=False))
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(out).cast(kind))

    return df.mapInArrow(run, schema)


def passthrough(df: DataFrame, in_capacity: int | None = None, out_capacity: int | None = None) -> DataFrame:
    """The same rows; capacities, if given, have to be equal."""
    if in_capacity is not None and out_capacity is not None and in_capacity != out_capacity:
        raise StreamError("CAPACITY_MISMATCH", f"input holds {in_capacity} samples a batch, output {out_capacity}")
    return df


def cast_samples(df: DataFrame, dtype: Dtype) -> DataFrame:
    """Samples in another type; what does not fit is null."""
    return df.withColumn("value", narrow(F.col("value"), dtype))


def fold_samples(df: DataFrame, step: Callable, start: Callable[[], object]) -> DataFrame:
    """A stateful map: ``step(state, t_ns, value) -> (state, value)`` over each series in order of ``seq``.

    Series are streamed through sorted partitions: a task holds one Arrow batch and one state, never a series.
    """
    rows = df.repartition("series_id").sortWithinPartitions("series_id", "seq")
    names = df.columns
    series_at, t_at, value_at = (names.index(c) for c in ("series_id", "t_ns", "value"))
    kind = pa.float32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, state = object(), None
        for batch in batches:
            out = []
            for s, t, v in zip(*(batch.column(i).to_pylist() for i in (series_at, t_at, value_at)), strict=True):
                if s != series:
                    series, state = s, start()
                state, v = step(state, t, v)
                out.append(v)
            yield batch.set_column(value_at, "value", pa.array(out, kind))

    return rows.mapInArrow(run, df.schema)


def low_pass(df: DataFrame, alpha: float) -> DataFrame:
    """y += alpha * (x - y), starting from the first sample (extension)."""

    def step(y, _t, x):
        y = x if y is None else y + alpha * (x - y)
        return y, y

    return fold_samples(df, step, lambda: None)


def remove_dc(df: DataFrame, alpha: float) -> DataFrame:
    """The sample less its running low-pass value (extension)."""

    def step(y, _t, x):
        y = x if y is None else y + alpha * (x - y)
        return y, x - y

    return fold_samples(df, step, lambda: None)
