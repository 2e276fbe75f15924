"""Tiers kept as a table, looked up by value: an interval join without a nested loop.

The axis of values is cut into bins, eight per power of four, mirrored at zero,
the outermost open. A tier is listed in each bin that it touches (some hundreds
at most, as the bins are bounded), a value falls into exactly one; so rows meet
the tiers of their own bin by an equi-join and compare with those alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercraft.functions.columns import col
from tiercraft.operators.skew import HOT_ROWS, join_hot

BINS, PER_DOUBLING = 160, 4


def value_bin(v: Column) -> Column:
    """The bin of a value (NULL: none): a function that never falls as the value rises."""
    steps = F.floor(F.log2(1 + F.abs(v)) * PER_DOUBLING)
    bounded = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.signum(v) * steps)).cast("int")
    return F.when(v.isNotNull(), bounded)       # least and greatest pass over a NULL


def with_upper(tiers: DataFrame, low: str, keys: list[str], high: str = "high") -> DataFrame:
    """A tier table of cutoffs with the upper end of each tier: the next cutoff of its keys, NULL for the last."""
    w = Window.partitionBy(*map(col, keys)).orderBy(col(low))
    return tiers.withColumn(high, F.lead(col(low)).over(w))


def band_join(rows: DataFrame, tiers: DataFrame, value: Column, keys: dict[str, str], low: str = "low",
              high: str = "high", hot_from: int = HOT_ROWS) -> DataFrame:
    """Every row with the tiers of its keys (row column: tier column) for which ``low <= value < high``.

    A NULL ``low`` or ``high`` is open. A row in several tiers comes once for each, a row in none
    (or without a value or key) once with NULL tier columns. Tier columns, less
    the keys, are added; rows of a (key, bin) beyond ``hot_from`` are dealt out.
    """
    added = [c for c in tiers.columns if c not in keys.values()]
    clash = set(added) & set(rows.columns)
    if clash:
        raise ValueError(f"rows and tiers share the columns {sorted(clash)}")
    names = [f"_key{i}" for i in range(len(keys))]
    first = F.coalesce(value_bin(col(low)), F.lit(-BINS))
    last = F.coalesce(value_bin(col(high)), F.lit(BINS))
    listed = (tiers.where(col(low).isNull() | col(high).isNull() | (col(low) < col(high)))
              .select(*[col(t).alias(n) for n, t in zip(names, keys.values(), strict=True)],
                      F.struct(*map(col, added)).alias("_tier"), F.explode(F.sequence(first, last)).alias("_bin"))
              .groupBy(*names, "_bin").agg(F.collect_list("_tier").alias("_tiers")))
    placed = rows.select("*", *[col(r).alias(n) for n, r in zip(names, keys, strict=True)],
                         value.alias("_value"), value_bin(value).alias("_bin"))
    filled = placed.groupBy(*names, "_bin").agg(F.count("*").alias("_n"))
    found = join_hot(placed, listed.join(filled, [*names, "_bin"]), [*names, "_bin"], "_n",
                     F.monotonically_increasing_id(), hot_from, how="left")

    def holds(t: Column) -> Column:
        v = F.col("_value")
        return ((t[low].isNull() | (v >= t[low])) & (t[high].isNull() | (v < t[high])))
    each = found.withColumn("_tier", F.explode_outer(F.filter("_tiers", holds)))
    return each.select(*map(col, rows.columns), *[F.col("_tier")[c].alias(c) for c in added])
