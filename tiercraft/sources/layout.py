"""Tables written in a layout that later reads profit from.

* :func:`write_bucketed`: one file per bucket of an id, so that periods written
  with the same number of buckets are joined without an exchange.
* :class:`SortedTable`: rows in order of a key, with the first and last key of
  each file beside them, so that a lookup opens the files that can hold its key
  and reads the pages of them that can, however large the table grows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercraft.functions.columns import col

JOIN_ID = "_join_id"


def write_bucketed(df: DataFrame, key: Column, table: str, buckets: int, path: str) -> DataFrame:
    """``df`` with its ``key`` as ``_join_id`` in a catalog table of files at ``path`` (a shared folder).

    The shuffle before the write has the buckets' hash, so each bucket is one sorted
    file. Meant for keys that are unique or nearly so (after the quarantine): a
    bucket is one task of the join. A table of that name is replaced.
    """
    (df.withColumn(JOIN_ID, key).repartition(buckets, JOIN_ID).sortWithinPartitions(JOIN_ID)
     .write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, JOIN_ID).sortBy(JOIN_ID).saveAsTable(table))
    return df.sparkSession.table(table)


@dataclass(frozen=True)
class SortedTable:
    """A table sorted by ``key`` under ``path``: ``rows`` (Parquet) and ``files`` (name, first, last)."""

    path: str
    key: str

    @classmethod
    def write(cls, df: DataFrame, key: str, path: str, files: int, order: Column | str | None = None) -> SortedTable:
        """Sort ``df`` by ``key`` (ties by ``order``, which also lets a key of very many rows
        spread over files) into at most ``files`` files. Rows with a NULL key come first."""
        by = [col(key)] if order is None else [col(key), col(order)]
        (df.repartitionByRange(files, *by).sortWithinPartitions(*by)
         .write.mode("overwrite").option("parquet.page.row.count.limit", "2000")
         .option("parquet.bloom.filter.enabled#" + key, "true").parquet(f"{path}/rows"))
        ends = (df.sparkSession.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("name"))
                .agg(F.min(col(key)).alias("first"), F.max(col(key)).alias("last")))
        # In order as well, so that a lookup reads one row group of the index; one row per file.
        ends.where("first IS NOT NULL").orderBy("first").coalesce(1).write.mode("overwrite").parquet(f"{path}/files")
        return cls(path, key)

    def lookup(self, spark: SparkSession, value) -> DataFrame:
        """The rows whose key is ``value``; the key's predicate reaches the scan of the files that can hold it."""
        files = (spark.read.parquet(f"{self.path}/files")
                 .where((F.col("first") <= F.lit(value)) & (F.col("last") >= F.lit(value))).select("name").collect())
        if not files:
            return spark.read.parquet(f"{self.path}/rows").limit(0)
        return (spark.read.parquet(*[f"{self.path}/rows/{r['name']}" for r in files])
                .where(col(self.key) == F.lit(value)))
