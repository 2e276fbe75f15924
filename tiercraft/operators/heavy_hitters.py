"""Most frequent values without shuffling every distinct value.

Each task keeps a Misra-Gries summary per column: at most ``SLOTS`` values with
lower bounds of their counts, and how much any value may have lost. Summaries
add up, and the sum of the losses bounds the count of every value that none of
them lists. If the k-th largest lower bound lies above it, the answer is among
the listed values; these few are counted exactly in a second pass whose shuffle
holds only them. A column without such frequent values is counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiercraft.functions.columns import col

SLOTS = 1024


def _keep_largest(counts: dict[str, int], slots: int) -> tuple[dict[str, int], int]:
    """The summary cut to ``slots`` values, and what each of them (and every other) lost."""
    if len(counts) <= slots:
        return counts, 0
    cut = sorted(counts.values(), reverse=True)[slots]
    return {v: n - cut for v, n in counts.items() if n > cut}, cut


def _summaries(columns: list[str], slots: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, int]] = [{} for _ in columns]
        lost = [0] * len(columns)
        for batch in batches:
            for i, values in enumerate(batch.columns):
                for pair in values.drop_null().value_counts().to_pylist():
                    kept[i][pair["values"]] = kept[i].get(pair["values"], 0) + pair["counts"]
                kept[i], cut = _keep_largest(kept[i], slots)
                lost[i] += cut
        rows = [(c, v, n, 0) for c, k in zip(columns, kept, strict=True) for v, n in k.items()]
        rows += [(c, None, 0, n) for c, n in zip(columns, lost, strict=True) if n]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
            ["column", "value", "n", "lost"])
    return summarise


def candidates(df: DataFrame, columns: list[str], k: int, slots: int = SLOTS) -> tuple[dict[str, list[str]], list[str]]:
    """Per proven column the values that can be among its ``k`` most frequent; and the other columns.

    The values number at most ``slots`` a column, otherwise the column counts as not proven.
    """
    texts = df.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    found = (texts.mapInArrow(_summaries(columns, slots), "column string, value string, n long, lost long")
             .groupBy("column", "value").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost")))
    loss = found.where("value IS NULL").select("column", F.col("lost").alias("loss"))
    listed = (found.where("value IS NOT NULL").select("column", "value", "n").join(F.broadcast(loss), "column", "left")
              .withColumn("loss", F.coalesce("loss", F.lit(0))))       # one row a column
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    kth = F.max(F.when(F.col("place") == k, F.col("n"))).over(Window.partitionBy("column"))
    # Fewer than k listed values are all there is if nothing was lost.
    able = (listed.withColumn("place", place).withColumn("kth", F.coalesce(kth, F.lit(0)))
            .where((F.col("kth") > F.col("loss")) | (F.col("loss") == 0))
            .where(F.col("n") + F.col("loss") >= F.col("kth")))
    able = able.withColumn("many", F.count("*").over(Window.partitionBy("column"))).where(F.col("many") <= slots)
    out: dict[str, list[str]] = {}
    for r in able.select("column", "value").collect():      # at most slots values a column
        out.setdefault(r["column"], []).append(r["value"])
    return out, [c for c in columns if c not in out]


def top_values(df: DataFrame, columns: list[str], k: int = 3, slots: int = SLOTS) -> DataFrame:
    """A19 at any number of distinct values: ``column``, ``value``, ``count``, ``rank`` of the ``k`` most
    frequent non-null values of each column, ties by value."""
    columns = [c for c in columns if c in df.columns]
    proven, rest = candidates(df, columns, k, slots)

    def pairs(names: list[str]) -> DataFrame:
        return (df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
                                             for c in names]))).where(F.col("value").isNotNull()))
    parts = []
    if proven:
        few = df.sparkSession.createDataFrame([(c, v) for c, vs in proven.items() for v in vs],
                                              "column string, value string")
        parts.append(pairs(list(proven)).join(F.broadcast(few), ["column", "value"]))
    if rest:
        parts.append(pairs(rest))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, rank int")
    counts = [p.groupBy("column", "value").agg(F.count("*").alias("count")) for p in parts]
    every = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
