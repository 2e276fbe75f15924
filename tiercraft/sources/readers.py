"""Readers: CSV (every column as text, pandas-style null tokens) and Parquet.

Every source carries ``_row_order`` so that "first occurrence" is defined
without relying on partition order: for files it is the struct
(file path, split start, position inside the split), which sorts in file
order no matter how the scan is split or packed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, StringType

from tiercraft.config import CSV_NA_TOKENS
from tiercraft.functions.columns import col

ROW_ORDER = "_row_order"


def _file_row_order() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos"))


def with_row_order(df: DataFrame) -> DataFrame:
    """Attach ``_row_order`` right after a file scan (no-op if present)."""
    if ROW_ORDER in df.columns:
        return df
    return df.withColumn(ROW_ORDER, _file_row_order())


def _null_tokens(df: DataFrame, tokens=CSV_NA_TOKENS) -> DataFrame:
    """Text cells equal to a null token become NULL; NaN doubles become NULL."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name == ROW_ORDER:
            out.append(c)
        elif isinstance(f.dataType, StringType):
            out.append(F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)
                       .alias(f.name))
        elif isinstance(f.dataType, FractionalType):
            out.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def read_records(spark: SparkSession, path: str | list[str], na_tokens=CSV_NA_TOKENS,
                 **options) -> DataFrame:
    """CSV with a header; all columns read as text (malformed cells survive to
    be parsed by the operators); pandas null tokens become NULL.

    Cells are read as pandas does: a doubled quote inside a quoted cell is one
    quote, a quoted cell may hold line breaks, blanks around a cell stay. All
    files must have the header of the first; a file with other or reordered
    columns fails the read instead of shifting its cells. Cells with line
    breaks keep a file from being split; ``multiLine=False`` makes large files
    without such cells splittable."""
    reader = (spark.read.option("header", "true").option("inferSchema", "false")
              .option("quote", '"').option("escape", '"').option("enforceSchema", "false")
              .option("multiLine", str(options.pop("multiLine", True)).lower()))
    for k, v in options.items():
        reader = reader.option(k, v)
    df = with_row_order(reader.csv(path))
    return _null_tokens(df, na_tokens)


def read_parquet_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = with_row_order(spark.read.parquet(path) if isinstance(path, str)
                        else spark.read.parquet(*path))
    return _null_tokens(df, ())
