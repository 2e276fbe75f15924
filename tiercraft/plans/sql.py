"""Q1/Q2: SQL over the segmented output, registered as view ``records``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiercraft.session import ensure_checkpoint_dir
from tiercraft.sources.readers import ROW_ORDER


def default_query(value_col: str) -> str:
    return (f'SELECT Segment, COUNT(*) AS records, ROUND(SUM("{value_col}"), 2) AS total_value\n'
            'FROM records\n'
            'GROUP BY Segment\n'
            'ORDER BY total_value DESC')


def register_records(segmented: DataFrame, name: str = "records") -> None:
    segmented.drop(ROW_ORDER).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, segmented: DataFrame, sql_text: str) -> DataFrame:
    """Run user SQL on ``records``; double-quoted names are identifiers (as
    in ANSI SQL). The query is run once and its result kept as a checkpoint, so
    errors of any kind, also those that only running finds (a failed cast),
    surface here as ``ValueError('Query failed: ...')``."""
    ensure_checkpoint_dir(spark)
    register_records(segmented)
    key = "spark.sql.ansi.doubleQuotedIdentifiers"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return spark.sql(sql_text).checkpoint()
    except Exception as err:  # whatever is wrong with the user's text
        raise ValueError(f"Query failed: {err}") from err
    finally:
        spark.conf.set(key, old)
