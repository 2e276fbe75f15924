"""Joins in which a few keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercraft.functions.columns import col

SALTS = 64
HOT_ROWS = 1_000_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n_col: str, spread: Column,
             hot_from: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and, in
    ``n_col``, the key's number of left rows (dropped from the result).

    A key of ``hot_from`` rows or more is hot. There are at most (left rows /
    ``hot_from``) hot keys, so the keys alone can be broadcast; their left rows
    are dealt by ``spread`` to SALTS parts, and the right row is repeated for
    each part. No task gets a hot key's rows alone.
    """
    hot = right.where(col(n_col) >= hot_from).select(*map(col, keys), F.lit(True).alias("__hot"))
    salted = (left.join(F.broadcast(hot), keys, "left")
              .withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)))
                          .otherwise(0).cast("int")).drop("__hot"))
    dealt = right.withColumn("__salt", F.explode(F.sequence(
        F.lit(0), F.when(col(n_col) >= hot_from, SALTS - 1).otherwise(0)))).drop(n_col)
    return salted.join(dealt, [*keys, "__salt"], how).drop("__salt")
