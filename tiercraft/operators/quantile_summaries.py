"""Quantile summaries that are kept per part of the data (day, file) and merged.

A summary row holds a part's exact count, least and greatest value and a KLL
sketch of its values. Summaries of new parts are appended, those of a replayed
part replaced, and the rows of any set of parts merge. The merged sketch tells
where an order statistic lies within its rank error, so the exact selection of
:mod:`tiercraft.operators.quantiles` starts from that narrow bracket and needs
neither the pass for count, least and greatest value nor its first round.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercraft.functions.columns import col
from tiercraft.operators.quantiles import _as_col, _Values, interpolate

K = 1024        # sketch size: about 25 KB a part and column


def rank_error(k: int = K) -> float:
    """The share of ranks by which a sketch of size ``k`` may be off (99 % of the time)."""
    return 2.296 / k ** 0.9021


def summarise(df: DataFrame, by: list[str], columns: list[str], k: int = K) -> DataFrame:
    """One row per part (``by``) and column: ``column``, ``n``, ``lo``, ``hi``, ``sketch``.

    NULL and NaN are no values; a part without values has n = 0. A part that
    holds most rows is summarised map-side, as all others."""
    values = df.select(*map(col, by), *[_as_col(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    rows = []
    for i, c in enumerate(columns):
        v = F.col(f"__v{i}")
        rows.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.min(v).alias("lo"),
                             F.max(v).alias("hi"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch")))
    return values.groupBy(*map(col, by)).agg(F.array(*rows).alias("__rows")).select(*map(col, by), F.inline("__rows"))


def merge(summaries: DataFrame) -> DataFrame:
    """The summaries of all parts as one row per column."""
    return (summaries.where("n > 0").groupBy("column")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                 F.kll_merge_agg_double("sketch").alias("sketch")))


def quantiles_from(df: DataFrame, specs: Mapping[str, tuple[str, float]], summaries: DataFrame,
                   k: int = K) -> dict[str, float | None]:
    """Exact linear-interpolated quantiles ``{name: (column, prob)}`` of ``df``, whose parts
    ``summaries`` describe; None for a column without values.

    The answer does not depend on the sketches: they only choose where the first
    round looks. Summaries of other data than ``df``'s are an error."""
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    merged = merge(summaries).where(F.col("column").isin(columns))
    counts = {r["column"]: (r["n"], r["lo"], r["hi"]) for r in merged.drop("sketch").collect()}
    stats = [counts.get(c, (0, None, None)) for c in columns]
    place = {name: (stats[columns.index(c)][0] - 1) * float(p) for name, (c, p) in specs.items() if c in counts}
    targets = {(columns.index(specs[name][0]), f(h)) for name, h in place.items() for f in (math.floor, math.ceil)}
    got = {}
    if targets:
        likely = _brackets(merged, columns, stats, targets, 2 * rank_error(k))
        with _Values(df, columns) as values:
            got = values.select(stats, targets, likely)
    return {name: (interpolate(got[columns.index(c), math.floor(place[name])],
                               got[columns.index(c), math.ceil(place[name])], place[name])
                   if name in place else None) for name, (c, _) in specs.items()}


def _brackets(merged: DataFrame, columns: list[str], stats: list, targets: set, error: float) -> dict:
    """Per target the values that the sketch finds ``error`` below and above its rank."""
    ranks = sorted(targets)
    ends = []
    for column, rank in ranks:
        share = (rank + 0.5) / stats[column][0]
        ends += [max(0.0, share - error), min(1.0, share + error)]
    shares = F.array(*map(F.lit, ends))     # the sketch functions take constant shares only
    found = {r["column"]: r["at"] for r in merged.select(
        "column", F.kll_sketch_get_quantile_double("sketch", shares).alias("at")).collect()}
    return {t: tuple(found[columns[t[0]]][2 * i:2 * i + 2]) for i, t in enumerate(ranks)}
