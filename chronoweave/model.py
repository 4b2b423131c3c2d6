"""Data model: sample types, the two frame layouts, buffer settings and errors.

Samples, the canonical layout, have one row per sample.  ``seq`` is the order of arrival within a series: nothing in Spark gives
rows an order, so every order-dependent operator reads it from there.  Times are nanoseconds in a LONG, never a TIMESTAMP (microseconds).
Batches, the derived layout, have one row per batch with the samples in an array.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum

from pyspark.sql import types as T


class Dtype(IntEnum):
    """Sample types; the numbers are what messages print."""

    NDEF = 0
    FLOAT = 1
    I32 = 2
    U32 = 3

    @property
    def spark(self) -> T.DataType:
        """Spark has no unsigned type: U32 is a LONG in 0 to 2^32-1."""
        return {Dtype.FLOAT: T.FloatType(), Dtype.I32: T.IntegerType(), Dtype.U32: T.LongType()}[self]

    @property
    def width(self) -> int:
        return 0 if self is Dtype.NDEF else 4


# Names of outcomes, in the order of their numbers.
ERROR_NAMES = """
OK COMPLETE STOPPED TIMEOUT PTHREAD_UNKOWN NOINPUT NOSPACE GET_HEAD_NULL TYPE_MISMATCH BAD_PYOBJECT COND_INIT_FAIL MUTEX_INIT_FAIL
NULL_FILTER ALREADY_RUNNING THREAD_CREATE_FAIL CAPACITY_MISMATCH THREAD_JOIN_FAIL DTYPE_MISMATCH WIDTH_MISMATCH DTYPE_INVALID
INVALID_DTYPE INVALID_CONFIG INVALID_CONFIG_WORKER INVALID_CONFIG_MAX_INPUTS INVALID_CONFIG_MAX_SINKS INVALID_CONFIG_FILTER_SIZE
INVALID_CONFIG_FILTER_T INVALID_CONFIG_TIMEOUT CONFIG_REQUIRED MALLOC_FAIL MEMCPY_FAIL MEMSET_FAIL THREAD_CREATE_NAME_FAIL BUFFER_EMPTY
CONNECTION_OCCUPIED INVALID_SINK_IDX NULL_BUFF ALREADY_REGISTERED NOT_IMPLEMENTED NULL_POINTER NO_SINK PHASE_ERROR TYPE_ERROR ALLOC
INVALID_DATA NO_SPACE INVALID_PRECISION FILTER_STOPPING PROPERTY_MISMATCH
""".split()

ErrorCode = Enum("ErrorCode", {name: i for i, name in enumerate(ERROR_NAMES)})


class StreamError(Exception):
    """An outcome other than OK, found while planning or running."""

    def __init__(self, code: ErrorCode | str, message: str = ""):
        self.code = ErrorCode[code] if isinstance(code, str) else code
        super().__init__(f"{self.code.name}: {message}" if message else self.code.name)
        self.message = message


class Overflow(Enum):
    """What a full buffer does: wait, lose the newest batch, or lose the oldest."""

    BLOCK = "block"
    DROP_HEAD = "drop_head"
    DROP_TAIL = "drop_tail"


@dataclass(frozen=True)
class BufferConfig:
    """Type and sizes of an input: 2^batch_expo samples a batch, 2^ring_expo slots of which one stays free."""

    dtype: Dtype = Dtype.FLOAT
    batch_expo: int = 6
    ring_expo: int = 8
    overflow: Overflow = Overflow.BLOCK

    MAX_RING, MAX_BATCH = 30, 20

    def __post_init__(self):
        if self.dtype is Dtype.NDEF:
            raise StreamError("INVALID_DTYPE", "a buffer needs a sample type")
        if not 0 <= self.ring_expo <= self.MAX_RING or not 0 <= self.batch_expo <= self.MAX_BATCH:
            raise StreamError("INVALID_CONFIG", f"ring exponent {self.ring_expo} or batch exponent {self.batch_expo} out of range")

    @property
    def capacity(self) -> int:
        return 1 << self.batch_expo

    @property
    def slots(self) -> int:
        return (1 << self.ring_expo) - 1


#: Buffer profiles that the tests run operators under.
PROFILES = {
    "default": BufferConfig(batch_expo=6, ring_expo=8),
    "tiny": BufferConfig(batch_expo=2, ring_expo=2),
    "small": BufferConfig(batch_expo=4, ring_expo=3),
    "large": BufferConfig(batch_expo=10, ring_expo=10),
    "back_pressure": BufferConfig(batch_expo=6, ring_expo=2),
    "performance": BufferConfig(batch_expo=10, ring_expo=8),
}


def samples_schema(dtype: Dtype = Dtype.FLOAT) -> T.StructType:
    fields = [("series_id", T.StringType()), ("seq", T.LongType()), ("t_ns", T.LongType()), ("period_ns", T.LongType()), ("value", dtype.spark)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def batches_schema(dtype: Dtype = Dtype.FLOAT) -> T.StructType:
    fields = [("series_id", T.StringType()), ("batch_id", T.LongType()), ("t_ns", T.LongType()), ("period_ns", T.LongType())]
    fields += [("n", T.IntegerType()), ("ec", T.IntegerType()), ("data", T.ArrayType(dtype.spark))]
    return T.StructType([T.StructField(n, t) for n, t in fields])
