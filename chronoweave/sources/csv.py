"""Delimited text as samples: one series for each selected column, all with the row's time.

Lines are read as text and cut by column functions, because rows are judged by rules that Spark's CSV reader does not have:
adjacent delimiters count as one, there are no quotes, every cell has to be a number (also those not selected), and
a line of 4095 bytes or more is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import narrow
from ..model import Dtype, StreamError

MAX_COLUMNS, MAX_LINE = 64, 4095
#: Parts of column names that mark a time column when the header is discovered.
TIME_MARKS = "time", "Time", "TIME", "timestamp", "Timestamp", "TIMESTAMP"
#: Decimal numbers with optional sign and exponent, infinity and not-a-number; no blanks after, no suffix, no hexadecimal.
NUMBER = r"^[ \t]*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
WHOLE = r"^[ \t]*\+?\d{1,19}$"


def cells_of(line: Column, delimiter: str) -> Column:
    """The cells of a line; adjacent delimiters count as one."""
    return F.filter(F.split(line, f"[{_escaped(delimiter)}]", -1), lambda c: c != "")


def _escaped(delimiter: str) -> str:
    if len(delimiter) != 1:
        raise StreamError("INVALID_CONFIG", "a delimiter is one character")
    return "\\" + delimiter if delimiter in "\\^]-[&" else delimiter


def _number(cell: Column) -> Column:
    """A cell as a double, null if it is not one, or too large for one."""
    low = F.lower(F.trim(cell))
    plain = low.try_cast("double")
    special = F.when(low.contains("nan"), F.lit(float("nan"))).when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    value = F.when(low.rlike("inf|nan"), special).when(F.abs(plain) < float("inf"), plain)
    return F.when(cell.rlike(NUMBER), value)


@dataclass
class CsvSource:
    """What to read from a file with a header line, or from the files of a folder, in the order of their paths, that all have the same one."""

    path: str
    ts_column: str
    data_columns: list[str]
    delimiter: str = ","
    skip_invalid: bool = False
    loops: int = 1
    dtype: Dtype = Dtype.FLOAT
    capacities: list[int] = field(default_factory=list)
    has_header: bool = True

    def __post_init__(self):
        if not self.has_header:
            raise StreamError("INVALID_CONFIG", "columns are found by the header line, so there has to be one")
        if not self.data_columns or len(self.data_columns) > MAX_COLUMNS:
            raise StreamError("INVALID_CONFIG", f"1 to {MAX_COLUMNS} data columns are read")
        if len(set(self.capacities)) > 1:
            raise StreamError("CAPACITY_MISMATCH", "all outputs have the same batch capacity")
        if self.loops < 1:
            raise StreamError("INVALID_CONFIG", "a file is read once at least")

    def header(self, spark: SparkSession) -> list[str]:
        """The names of the first line; one row goes to the driver."""
        first = spark.read.text(self.path).limit(1).collect()
        if not first:
            raise StreamError("INVALID_CONFIG", f"{self.path} is empty")
        line = first[0][0]
        if len(line.encode()) >= MAX_LINE:
            raise StreamError("INVALID_CONFIG", "the header line is too long")
        return [c.strip() for c in line.split(self.delimiter) if c]

    def read(self, spark: SparkSession) -> DataFrame:
        """Samples of the selected columns: series_id is the column's name, seq the row's place in the file (and its loops)."""
        names = self.header(spark)
        missing = [c for c in [self.ts_column, *self.data_columns] if c not in names]
        if missing:
            raise StreamError("INVALID_CONFIG", f"no column {', '.join(missing)} in {self.path}")
        # Numbers of lines rise with their place within a part of a file; parts are in order by file and first byte.
        text = spark.read.text(self.path)
        lines = text.select(
            "value", F.monotonically_increasing_id().alias("cw_at"),
            F.col("_metadata.file_path").alias("cw_file"), F.col("_metadata.file_block_start").alias("cw_block"),
        )
        body = lines.where(F.col("cw_at") != 0) if len(text.inputFiles()) == 1 else _without_headers(lines, self.delimiter, names)
        rows = parse_lines(body, names, self.ts_column, self.data_columns, self.delimiter, self.skip_invalid, self.dtype)
        if self.loops > 1:
            rows = rows.withColumn("cw_loop", F.explode(F.sequence(F.lit(0), F.lit(self.loops - 1))))
        else:
            rows = rows.withColumn("cw_loop", F.lit(0))
        numbered = _numbered(rows)
        value = F.explode(F.array(*(F.struct(F.lit(c).alias("s"), F.col("cw_values")[i].alias("v")) for i, c in enumerate(self.data_columns))))
        out = numbered.select("seq", "t_ns", value.alias("p"))
        return out.select(
            F.col("p.s").alias("series_id"), "seq", "t_ns", F.lit(0).cast("long").alias("period_ns"), F.col("p.v").alias("value"),
        )


def _without_headers(lines: DataFrame, delimiter: str, names: list[str]) -> DataFrame:
    """Lines of several files, null in place of each file's first; the names there have to be ``names``.  Only one row per file is joined.

    The line itself depends on the join, so that no later judgement of lines can be made before it.
    """
    first = lines.where("cw_block = 0").groupBy("cw_file").agg(F.min("cw_at").alias("cw_first"), F.min_by("value", "cw_at").alias("cw_header"))
    own = F.transform(cells_of(F.col("cw_header"), delimiter), F.trim)
    other = F.raise_error(F.concat(F.lit("INVALID_CONFIG: another header in "), "cw_file")).cast("string")
    line = F.when(own == F.array(*map(F.lit, names)), F.when(F.col("cw_at") != F.col("cw_first"), F.col("value"))).otherwise(other)
    return lines.join(first, "cw_file").withColumn("value", line).drop("cw_first", "cw_header")


def _numbered(rows: DataFrame) -> DataFrame:
    """Gapless numbers in the order of (loop, file, line): counts of parts of files first, then places within them."""
    part = ["cw_loop", "cw_file", "cw_block"]
    counts = rows.groupBy(*part).agg(F.count("*").alias("cw_n"))
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)  # one row per file part
    starts = counts.select(*part, F.coalesce(F.sum("cw_n").over(before), F.lit(0)).alias("cw_start"))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("cw_at"))
    out = rows.withColumn("cw_place", place).join(starts, part)
    return out.withColumn("seq", (F.col("cw_start") + F.col("cw_place") - 1).cast("long"))


def parse_lines(
    lines: DataFrame, names: list[str], ts_column: str, data_columns: list[str], delimiter: str = ",", skip_invalid: bool = False, dtype: Dtype = Dtype.FLOAT
) -> DataFrame:
    """Lines (column ``value``) with ``t_ns`` and ``cw_values``, an array of the selected cells.

    A row is invalid if its time or any cell under a name is no number, or if it has no cell; invalid rows go, or raise INVALID_DATA.
    Missing cells at the end are 0; cells beyond the names are ignored; null in place of a line is no row.
    """
    cells = lines.withColumn("cw_cells", cells_of(F.col("value"), delimiter))
    at = F.col("cw_cells")
    ts_at = names.index(ts_column)
    long_line = F.octet_length("value") >= MAX_LINE
    time_text = F.get(at, F.lit(ts_at))
    t = F.when(time_text.rlike(WHOLE), F.trim(F.replace(time_text, F.lit("+"), F.lit(""))).try_cast("bigint"))
    others = F.transform(F.filter(F.slice(at, 1, len(names)), lambda x, i: i != ts_at), _number)
    valid = (F.size(at) > 0) & t.isNotNull() & F.forall(others, lambda x: x.isNotNull())
    values = F.array(*(narrow(F.coalesce(_number(F.get(at, F.lit(names.index(c)))), F.lit(0.0)), dtype) for c in data_columns))
    judged = cells.withColumn("t_ns", t).withColumn("cw_values", values).withColumn("cw_valid", F.coalesce(valid, F.lit(False)))
    error = F.when(long_line, F.raise_error(F.lit("INVALID_DATA: line too long")).cast("boolean"))
    none = F.when(F.col("value").isNull(), F.lit(False))
    if skip_invalid:
        judged = judged.where(F.coalesce(none, error, F.col("cw_valid")))
    else:
        bad = F.raise_error(F.concat(F.lit("INVALID_DATA: "), F.substring("value", 1, 80))).cast("boolean")
        judged = judged.where(F.coalesce(none, error, F.when(F.col("cw_valid"), F.lit(True)).otherwise(bad)))
    return judged.drop("cw_cells", "cw_valid", "value")


def discover_header(names: list[str]) -> tuple[str, list[str]]:
    """The last name that speaks of time, and all others."""
    found = [n for n in names if any(mark in n for mark in TIME_MARKS)]
    if not found:
        raise StreamError("INVALID_CONFIG", "no time column in the header")
    return found[-1], [n for n in names if n != found[-1]]
