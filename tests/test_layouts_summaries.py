"""Bucketed periods, sorted tables and quantile summaries: plans, rows read, and results by brute force."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiercraft.operators import explain, trend
from tiercraft.operators import quantile_summaries as qs
from tiercraft.operators import quantiles as q
from tiercraft.sources.layout import SortedTable
from tiercraft.sources.readers import ROW_ORDER


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def _rows_read(df) -> int:
    """Rows that left the file scans of an executed frame."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numOutputRows").value()
    return total


def _periods(spark, n):
    cur = spark.createDataFrame([(f" P{i}" if i % 2 else f"P{i}", float(i % 17)) for i in range(n)], "PlayerID string, NetADT double")
    prior = spark.createDataFrame([(f"P{i} ", float(i % 5), i) for i in range(0, n, 3)] + [("P3", 99.0, n), (None, 1.0, n + 1)],
                                  f"PlayerID string, NetADT double, {ROW_ORDER} long")
    return cur, prior


def test_stored_periods_meet_without_exchange(spark, tmpdir_path):
    cur, prior = _periods(spark, 500)
    name = uuid.uuid4().hex
    a = trend.store_current(cur, "PlayerID", f"c{name}", 4, f"{tmpdir_path}/c")
    b = trend.store_prior(prior, "PlayerID", f"p{name}", 4, f"{tmpdir_path}/p")
    out = trend.apply_trend_stored(a, b)
    plan = _final_plan(out)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = trend.apply_trend(cur, prior, "PlayerID")
    assert sorted(map(repr, out.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_stored_periods_of_nothing(spark, tmpdir_path):
    cur, prior = _periods(spark, 10)
    name = uuid.uuid4().hex
    a = trend.store_current(cur, "PlayerID", f"c{name}", 4, f"{tmpdir_path}/c")
    b = trend.store_prior(prior.limit(0), "PlayerID", f"p{name}", 4, f"{tmpdir_path}/p")
    assert trend.apply_trend_stored(a, b).where("Trend = 'No prior data'").count() == 10


def test_lookup_reads_as_much_of_a_tenfold_table(spark, tmpdir_path):
    read = []
    for n in (10_000, 100_000):
        d = spark.range(n).select(F.format_string("P%09d", "id").alias("PlayerID"), F.col("id").alias("v"))
        stored = SortedTable.write(d.repartition(3), "PlayerID", f"{tmpdir_path}/{n}", files=n // 5_000)
        found = stored.lookup(spark, "P%09d" % (n // 2))
        assert "PushedFilters: [IsNotNull(PlayerID), EqualTo(PlayerID," in _final_plan(found)
        assert [r.v for r in found.collect()] == [n // 2]
        read.append(_rows_read(stored.lookup(spark, "P%09d" % (n // 2))))
    assert 0 < read[1] <= 2 * read[0] <= 10_000, read


def test_lookups_equal_scans(spark, tmpdir_path):
    rng = random.Random(5)
    rows = [(f"id{i}", rng.choice([None, "hot", "hot", f"n{i % 40}", ""]), i) for i in range(800)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, f"PlayerID string, FullName string, {ROW_ORDER} long").repartition(5)
    stored = explain.StoredRecords.write(d, "PlayerID", tmpdir_path, files=6)
    for pick in ("hot", "n3", "", "n39", "absent", None, "zzz", " "):
        assert stored.by_name(spark, pick).collect() == explain.lookup_by_name(d, pick).collect(), pick
    for one in ("id0", "id799", "id42", "a", "z", None):
        assert stored.by_id(spark, one).collect() == explain.record_lookup(d, "PlayerID", one).collect(), one


def test_lookup_in_an_empty_table(spark, tmpdir_path):
    d = spark.createDataFrame([], "id string, v long")
    assert SortedTable.write(d, "id", tmpdir_path, files=4).lookup(spark, "x").count() == 0


def _parts(spark):
    rng = random.Random(9)
    rows = [(i % 7, rng.choice([None, float("nan"), 3.5, 3.5, rng.gauss(0, 1e6), rng.random()]), float(i % 3)) for i in range(6000)]
    rows += [(99, None, None)] * 3 + [(None, float("inf"), -1.0), (None, float("-inf"), 1e308)]
    return rows, spark.createDataFrame(rows, "day int, v double, w double").repartition(6)


def test_quantiles_from_summaries_are_exact_with_fewer_passes(spark, monkeypatch):
    rows, d = _parts(spark)
    kept = qs.summarise(d, ["day"], ["v", "w"], k=64).checkpoint()
    assert kept.count() == 2 * 9
    specs = {f"{c}{p}": (c, p) for c in ("v", "w") for p in (0, 0.01, 0.25, 0.5, 0.9, 1)}
    want = q.multi_quantiles(d, specs)
    passes = []
    counted, stats = q._Values.histogram, q._Values.stats
    monkeypatch.setattr(q._Values, "histogram", lambda self, *a, **k: (passes.append(1), counted(self, *a, **k))[1])
    monkeypatch.setattr(q._Values, "stats", lambda self: (passes.append(1), stats(self))[1])
    assert q.multi_quantiles(d, specs) == want
    plain = len(passes)
    passes.clear()
    assert qs.quantiles_from(d, specs, kept, k=64) == want
    assert len(passes) < plain


def test_a_wrong_bracket_costs_no_result(spark, monkeypatch):
    _, d = _parts(spark)
    kept = qs.summarise(d, ["day"], ["v", "w"])
    specs = {f"{c}{p}": (c, p) for c in ("v", "w") for p in (0, 0.3, 0.6, 1)}
    want = q.multi_quantiles(d, specs)
    for wrong in ((-1e9, -1e8), (3.5, 3.5), (1e200, 1e201), (0.5, 0.6)):
        monkeypatch.setattr(qs, "_brackets", lambda m, c, s, targets, e, wrong=wrong: {t: wrong for t in targets})
        assert qs.quantiles_from(d, specs, kept) == want


def test_summaries_grow_by_part_and_must_fit(spark):
    _, d = _parts(spark)
    first, rest = d.where("day <= 3"), d.where("day > 3 OR day IS NULL")
    both = qs.summarise(first, ["day"], ["v"]).unionByName(qs.summarise(rest, ["day"], ["v"]))
    assert qs.quantiles_from(d, {"m": ("v", 0.5)}, both) == q.multi_quantiles(d, {"m": ("v", 0.5)})
    with pytest.raises(ValueError):
        qs.quantiles_from(d, {"m": ("v", 0.5)}, qs.summarise(first, ["day"], ["v"]))
    empty = d.limit(0)
    assert qs.quantiles_from(empty, {"m": ("v", 0.5)}, qs.summarise(empty, ["day"], ["v"])) == {"m": None}
    assert qs.quantiles_from(d, {"m": ("x", 0.5)}, both) == {"m": None}


def test_rank_error_of_merged_sketches(spark):
    n, k = 200_000, 256
    d = spark.range(n).select((F.col("id") % 50).alias("day"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    merged = qs.merge(qs.summarise(d, ["day"], ["v"], k=k))
    values = np.sort(np.array([r.v for r in d.select("v").collect()]))
    shares = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    at = merged.select(F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, shares))).alias("x")).first()["x"]
    off = [abs(np.searchsorted(values, x) / n - p) for x, p in zip(at, shares, strict=True)]
    assert max(off) <= 2 * qs.rank_error(k) and math.isclose(qs.rank_error(k), 0.0154, abs_tol=0.001)
