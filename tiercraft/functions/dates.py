"""Date parsing and day arithmetic."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, TimestampNTZType, TimestampType

from tiercraft.config import DATE_FORMATS, ZONED_DATE_FORMATS
from tiercraft.functions.columns import ColumnOrName
from tiercraft.functions.columns import col as _col


def parse_date(c: ColumnOrName, dtype: DataType | None = None, day_first: bool = False) -> Column:
    """Date text to timestamp, trying an explicit ordered list of formats
    (blanks around are ignored, a time with a zone is read as its UTC time);
    unreadable text is NULL. Date/timestamp columns pass through. With
    ``day_first`` (see :func:`day_first_columns`) dates with slashes begin with the day."""
    c = _col(c)
    if isinstance(dtype, (DateType, TimestampType, TimestampNTZType)):
        return c.cast("timestamp_ntz")
    s = F.trim(c.cast("string"))
    zoned = [F.to_utc_timestamp(F.try_to_timestamp(s, F.lit(fmt)), F.current_timezone())
             for fmt in ZONED_DATE_FORMATS]
    formats = [_turned(fmt) for fmt in DATE_FORMATS] if day_first else DATE_FORMATS
    plain = [F.try_to_timestamp(s, F.lit(fmt)) for fmt in formats]
    return F.coalesce(*[t.cast("timestamp_ntz") for t in plain + zoned])


def _turned(fmt: str) -> str:
    return fmt.replace("M/d/", "d/M/") if fmt.startswith("M/d/") else fmt


def day_first_columns(df: DataFrame, names: list[str], order: ColumnOrName) -> dict[str, bool]:
    """Per text column, whether its dates with slashes begin with the day.

    The first such date of a column in ``order`` decides for all its cells: it is read
    month first where that is a date, else day first. One aggregate for all columns.
    """
    if not names:
        return {}

    def first(name: str) -> Column:
        s = F.trim(_col(name).cast("string"))
        return F.min_by(s, F.when(F.regexp_like(s, F.lit(r"^[0-9]{1,2}/[0-9]{1,2}/")), _col(order)))

    def reads(c: Column, turned: bool) -> Column:
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(_turned(fmt) if turned else fmt))
                            for fmt in DATE_FORMATS if fmt.startswith("M/d/")]).isNotNull()
    firsts = df.agg(*[first(n).alias(f"c{i}") for i, n in enumerate(names)])
    row = firsts.select(*[(~reads(F.col(f"c{i}"), False) & reads(F.col(f"c{i}"), True)).alias(f"c{i}")
                          for i in range(len(names))]).first()
    return {n: bool(row[i]) for i, n in enumerate(names)}


def unparsed_share(df: DataFrame, name: str) -> DataFrame:
    """Share of the non-missing cells of a date column that do not parse."""
    c = _col(name)
    bad = parse_date(c, df.schema[name].dataType).isNull() & c.isNotNull()
    return df.agg((F.count_if(bad) / F.greatest(F.count(c), F.lit(1))).alias("date_unparsed_rate"))


def days_since(ts: ColumnOrName, as_of: datetime | str) -> Column:
    """Whole days from ``ts`` to the ``as_of`` instant, floored (a timestamp
    at 10:00 two days before midnight gives 1, not 2). Wall-clock arithmetic
    on timestamp_ntz: no session time zone (and no daylight-saving hour)
    enters the difference."""
    ref = F.lit(str(as_of)).cast("timestamp_ntz")
    secs = F.timestamp_diff("SECOND", _col(ts).cast("timestamp_ntz"), ref)
    return F.floor(secs / F.lit(86400)).cast("bigint")
