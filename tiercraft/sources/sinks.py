"""Sinks: CSV exports, text reports, header-only templates, roster."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql.types import StructType

from tiercraft.config import ROSTER_COLUMNS
from tiercraft.functions.columns import col
from tiercraft.sources.readers import ROW_ORDER


def _flat(df: DataFrame) -> DataFrame:
    """CSV cannot hold structs: a struct row order is dropped from exports."""
    if ROW_ORDER in df.columns and isinstance(df.schema[ROW_ORDER].dataType, StructType):
        return df.drop(ROW_ORDER)
    return df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False
              ) -> None:
    """Write every row and column with a header. Large outputs stay
    partitioned (one file per task); ``single_file`` is for small reports."""
    out = _flat(df)
    if single_file:
        out = out.coalesce(1)
    _csv(out.write.mode(mode)).csv(path)


def _csv(writer: DataFrameWriter) -> DataFrameWriter:
    """Quotes doubled and blanks kept, so that any CSV reader gets the cells back."""
    return (writer.option("header", "true").option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", "false")
            .option("ignoreTrailingWhiteSpace", "false"))


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a (line_no, line) report as one ordered text file. Reports are
    bounded (a few lines per segment), so one task writes them."""
    (lines.orderBy("line_no").select("line").coalesce(1)
     .write.mode(mode).text(path))


def write_template(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header-only CSV with the columns of ``df``."""
    _csv(_flat(df).limit(0).coalesce(1).write.mode(mode)).csv(path)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First n rows in source order."""
    if ROW_ORDER in df.columns:
        return df.orderBy(ROW_ORDER).limit(n)
    return df.limit(n)


def roster(segmented: DataFrame, id_col: str | None, value_col: str | None) -> DataFrame:
    """Projection of the roster columns that exist, in roster order."""
    keep = []
    for c in ROSTER_COLUMNS:
        name = c.format(id=id_col or "", value=value_col or "")
        if name and name in segmented.columns and name not in keep:
            keep.append(name)
    return segmented.select(*map(col, keep))
