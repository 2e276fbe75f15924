"""Exact order statistics and linear-interpolated quantiles at any scale.

Spark's exact ``percentile`` merges one value->count map per group in a single
reducer: for a global cut over billions of distinct values that reducer holds
them all. Here the exact answer comes from distributed selection:

1. the value columns are projected and persisted once as a thin frame; one
   aggregate gives each column's count, min and max (skipped when the caller
   knows them);
2. one aggregate per round counts the values of each open bracket [lo, hi] in
   ``BINS`` equal-width bins, with each bin's own min and max; the two ends have
   bins of their own. The bin that holds a target rank becomes its next bracket.

A bracket's ends leave it in every round, so each round shrinks it, by a factor
of about ``BINS`` on ordinary data (two rounds for millions of values), and the
selection always ends. A value that holds a third of all rows is an end of its
bin sooner or later and resolves there. There is one plan for every input size:
per round one partial aggregate per task and at most ``BINS + 2`` rows per
bracket at the driver.

Quantiles interpolate linearly between the two order statistics around
``h = q * (n - 1)``, evaluated as ``fma(1 - d, x1, d * x2)`` with
``d = h - floor(h)`` (one rounding of the weighted sum; this is what
DuckDB's quantile_cont computes, bit for bit).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercraft.functions.columns import col

BINS = 4096             # bins per bracket and round
ACCURACY = 20_000       # percentile_approx accuracy (relative error 1/ACCURACY)

Stats = tuple[int, float | None, float | None]


def interpolate(x1: float, x2: float, h: float) -> float:
    """Linear interpolation between the order statistics at floor(h) and
    ceil(h)."""
    d = h - math.floor(h)
    if d == 0 or x1 == x2:
        return x1
    return math.fma(1.0 - d, x1, d * x2)


def _bin_of(bins: list[tuple], rank: int) -> tuple[float, float, int]:
    """(min, max, rank within) of the bin that holds a rank."""
    for n, lo, hi in bins:
        if rank < n:
            return lo, hi, rank
        rank -= n
    raise ValueError("the values changed between two rounds")


def _as_col(value: Column | str) -> Column:
    return F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))


class _Values:
    """The value columns v0, v1, ... of a frame, persisted while in use."""

    def __init__(self, df: DataFrame, columns: list[Column | str]):
        self.n = len(columns)
        self.frame = df.select(*[_as_col(c).alias(f"v{i}") for i, c in enumerate(columns)])

    def __enter__(self) -> _Values:
        self.frame = self.frame.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def __exit__(self, *_) -> None:
        self.frame.unpersist()

    def stats(self) -> list[Stats]:
        aggs = [f(F.col(f"v{i}")).alias(f"{name}{i}") for i in range(self.n)
                for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
        row = self.frame.agg(*aggs).first()
        return [(int(row[f"n{i}"]), row[f"lo{i}"], row[f"hi{i}"]) for i in range(self.n)]

    def bins(self, brackets: list[tuple[int, float, float]], outside: bool = False) -> DataFrame:
        """(b, bin, n, lo, hi) for the values in each bracket (column, lo, hi); with ``outside``
        also one bin of all values below the bracket and one of all above."""
        cells = []
        for b, (k, lo, hi) in enumerate(brackets):
            v = F.col(f"v{k}")
            # Halved, so that the width of the widest bracket stays finite; with an
            # infinite end the share is undefined and all inner values share a bin.
            share = (v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2 if lo < hi else 1.0)
            inner = F.coalesce(F.floor(F.nanvl(share, F.lit(0.0)) * BINS).cast("int"), F.lit(0))
            place = (F.when(v == F.lit(lo), 0).when(v == F.lit(hi), BINS + 1)
                     .otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(BINS - 1)) + 1))
            if outside:
                place = F.when(v < F.lit(lo), -1).when(v > F.lit(hi), BINS + 2).otherwise(place)
            taken = v.isNotNull() if outside else v.between(F.lit(lo), F.lit(hi))
            cells.append(F.when(taken, F.struct(
                F.lit(b).alias("b"), place.alias("bin"), v.alias("v"))))
        if len(cells) == 1:
            rows = self.frame.select(cells[0].alias("c")).where("c IS NOT NULL").select("c.*")
        else:
            rows = self.frame.select(F.inline(F.array_compact(F.array(*cells))))
        return rows.groupBy("b", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"),
                                            F.max("v").alias("hi"))

    def histogram(self, brackets: list[tuple[int, float, float]], outside: bool = False) -> list[list[tuple]]:
        """Per bracket: its bins in order, as (count, min, max)."""
        out: list[list[tuple]] = [[] for _ in brackets]
        for r in self.bins(brackets, outside).collect():
            out[r["b"]].append((r["bin"], r["n"], r["lo"], r["hi"]))
        return [[x[1:] for x in sorted(bins)] for bins in out]

    def select(self, stats: list[Stats], targets: set[tuple[int, int]],
               likely: Mapping[tuple[int, int], tuple[float, float]] | None = None
               ) -> dict[tuple[int, int], float]:
        """The value at each target (column, 0-based rank among its non-null values).

        ``likely`` names a bracket (lo, hi) per target in which its value probably lies. The first
        round counts what lies outside as well, so a wrong bracket costs a round, not the answer."""
        answer: dict[tuple[int, int], float] = {}
        place = {t: (stats[t[0]][1], stats[t[0]][2], t[1]) for t in targets}
        if likely:
            self._narrow(place, {t: likely[t] for t in targets}, [s[0] for s in stats])
        while True:
            for t, (lo, hi, _) in place.items():
                if lo == hi:
                    answer[t] = lo
            waiting = defaultdict(list)
            for t, (lo, hi, _) in place.items():
                if t not in answer:
                    waiting[t[0], lo, hi].append(t)
            if not waiting:
                return answer
            for bins, open_targets in zip(self.histogram(list(waiting)), waiting.values(),
                                          strict=True):
                for t in open_targets:
                    place[t] = _bin_of(bins, place[t][2])

    def _narrow(self, place: dict, likely: dict, counts: list[int]) -> None:
        brackets = defaultdict(list)
        for t, (lo, hi) in likely.items():
            brackets[t[0], lo, hi].append(t)
        for bracket, bins in zip(brackets, self.histogram(list(brackets), outside=True), strict=True):
            known, found = counts[bracket[0]], sum(n for n, _, _ in bins)
            if found != known:
                raise ValueError(f"{known} values are summarised, the data hold {found}")
            for t in brackets[bracket]:
                place[t] = _bin_of(bins, place[t][2])


def order_statistics(df: DataFrame, value: Column | str,
                     ranks: Mapping[str, int] | Callable[[int], Mapping[str, int]],
                     stats: Stats | None = None) -> dict[str, float | None]:
    """Values at 0-based ascending ranks among the non-null values of ``value``.

    ``ranks`` may be a function of n (the non-null count); ``stats`` is a known
    (count, min, max) that saves the counting pass."""
    with _Values(df, [value]) as values:
        known = [stats] if stats is not None else values.stats()
        n = known[0][0]
        wanted = dict(ranks(n) if callable(ranks) else ranks)
        if n == 0:
            return {k: None for k in wanted}
        got = values.select(known, {(0, r) for r in wanted.values()})
        return {k: got[0, r] for k, r in wanted.items()}


def quantiles(df: DataFrame, value: Column | str, probs: Mapping[str, float],
              method: str = "exact", stats: Stats | None = None) -> dict[str, float | None]:
    """Linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``).

    method: ``exact`` (distributed selection, default), ``spark`` (built-in
    ``percentile``; exact but one reducer holds every distinct value) or
    ``approx`` (``percentile_approx``: an element, not an interpolation).
    ``stats`` = (non-null count, min, max) when the caller already has them
    (saves the counting pass)."""
    return multi_quantiles(df, {k: (value, p) for k, p in probs.items()}, method,
                           {value: stats} if stats is not None and isinstance(value, str)
                           else None)


def multi_quantiles(df: DataFrame, specs: Mapping[str, tuple[Column | str, float]],
                    method: str = "exact", stats: Mapping[str, Stats] | None = None
                    ) -> dict[str, float | None]:
    """Quantiles of several columns at once: ``{name: (column, prob)}``.
    Targets on the same column (same name or Column object) share a histogram.
    ``stats`` maps column names to known (count, min, max)."""
    if not specs:
        return {}
    if method in ("spark", "approx"):
        aggs = []
        for name, (c, p) in specs.items():
            v = _as_col(c)
            aggs.append((F.percentile(v, float(p)) if method == "spark"
                         else F.percentile_approx(v, float(p), ACCURACY)).alias(name))
        row = df.agg(*aggs).first()
        return {k: row[k] for k in specs}
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r}")

    columns: list[Column | str] = []
    key_of: dict[str, int] = {}
    for name, (c, _) in specs.items():
        same = [i for i, seen in enumerate(columns)
                if seen is c or (isinstance(c, str) and isinstance(seen, str) and seen == c)]
        if not same:
            columns.append(c)
        key_of[name] = same[0] if same else len(columns) - 1
    with _Values(df, columns) as values:
        given = stats or {}
        known = ([given[c] for c in columns]
                 if all(isinstance(c, str) and c in given for c in columns) else values.stats())
        place = {name: (known[key_of[name]][0] - 1) * float(p) for name, (_, p) in specs.items()
                 if known[key_of[name]][0]}
        got = values.select(known, {(key_of[name], f(h)) for name, h in place.items()
                                    for f in (math.floor, math.ceil)})
    return {name: (interpolate(got[key_of[name], math.floor(place[name])],
                               got[key_of[name], math.ceil(place[name])], place[name])
                   if name in place else None) for name in specs}
