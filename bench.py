"""Benchmark: the headline segmentation runs at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each mode run (quarantine -> clean -> segment [-> trend]) materialises its
stages once; the reports then read the persisted segmented frame, which is
how the library is meant to be used.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import StorageLevel  # noqa: E402

from tiercraft.config import COMPANY_MEANINGS, CUSTOM_MEANINGS  # noqa: E402
from tiercraft.operators import rollup, trend, worklist  # noqa: E402
from tiercraft.operators.quantiles import quantiles  # noqa: E402
from tiercraft.plans import runner  # noqa: E402
from tiercraft.plans.sql import default_query, run_sql  # noqa: E402
from tiercraft.session import build_session  # noqa: E402
from tiercraft.sources import fixtures as fx  # noqa: E402


def _loaded(df):
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def _sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def run_all(spark, sf_dir: str) -> tuple[dict[str, float], dict[str, float]]:
    """Every headline run and report on the tables in ``sf_dir``."""
    timings: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        timings[name] = round(time.perf_counter() - t0, 3)
        return out

    def load(name, frame):
        # Derive a record table from the star schema once (the "input file").
        return timed(name, lambda: _loaded(frame))

    players_in = load("load_players", fx.players_dirty(spark, sf_dir))
    prior_in = load("load_prior", fx.prior(spark, sf_dir))
    players = timed("players_run", lambda: runner.run_players(players_in, prev=prior_in))
    seg = players.segmented
    timed("value_table", lambda: players.value_table().collect())
    timed("segment_overview", lambda: rollup.segment_overview(seg, "NetADT").collect())
    timed("top_per_segment", lambda: worklist.top_per_segment(seg, "NetADT", "PlayerID")
          .collect())
    timed("worklist", lambda: _sink(worklist.host_worklist(seg, id_col="PlayerID")))
    timed("value_bands", lambda: players.value_bands().collect())
    timed("distribution_insight", lambda: players.distribution_insight().collect())
    timed("trend_report", lambda: (trend.trend_counts(seg).collect(),
                                   trend.top_declines(seg).collect(),
                                   trend.trend_insight(seg).collect()))
    timed("profile_players", lambda: rollup.profile(seg, "players").collect())
    timed("sql_records", lambda: run_sql(spark, seg, default_query("NetADT")).collect())
    timed("pareto", lambda: rollup.pareto(fx.offers(spark, sf_dir)).collect())
    players.release()

    companies_in = load("load_companies", fx.companies(spark, sf_dir))
    companies = timed("companies_run", lambda: runner.run_companies(companies_in))
    timed("companies_reports", lambda: (
        companies.value_table().collect(),
        rollup.segment_counts(companies.segmented, COMPANY_MEANINGS).collect(),
        rollup.profile(companies.segmented, "companies").collect()))
    companies.release()

    custom_in = load("load_custom", fx.custom(spark, sf_dir))
    custom = timed("custom_run", lambda: runner.run_custom(
        custom_in, "ref_id", "worth", "recency_days"))
    timed("custom_reports", lambda: (
        rollup.segment_stats(custom.segmented, "worth", CUSTOM_MEANINGS).collect(),
        custom.value_bands().collect()))
    custom.release()

    lines_in = load("load_lines", fx.lines(spark, sf_dir))
    lines = timed("lines_run", lambda: runner.run_custom(
        lines_in, "line_id", "amount", "days_since_ship"))
    timed("lines_reports", lambda: (
        lines.value_table().collect(),
        lines.value_bands().collect(),
        _sink(lines.segmented)))
    # SURVEY 7.3 step 10: exact selection vs Spark's exact percentile (one
    # reducer holds every distinct value) vs percentile_approx, same data.
    methods = {}
    for method in ("exact", "spark", "approx"):
        t0 = time.perf_counter()
        quantiles(lines_in, "amount", {"cut": 0.75, "low": 0.25}, method=method)
        methods[method] = round(time.perf_counter() - t0, 3)
    lines.release()
    for frame in (players_in, prior_in, companies_in, custom_in, lines_in):
        frame.unpersist()
    return timings, methods


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))
    # Warm-up: the same sequence, untimed, on the smallest tables (other data,
    # so nothing of the timed run is cached); it pays JVM start and code
    # generation once, which at 100 TB is noise and at sf0.1 would dominate.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warmed = os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir)
    if warmed:
        run_all(spark, warm_dir)
    timings, methods = run_all(spark, sf_dir)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "segmentation_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings,
                      "sf": float(m.group(1)) if m else sf_dir,
                      "warmup": warm_dir if warmed else None,
                      "quantile_methods_sec": methods}))
    spark.stop()


if __name__ == "__main__":
    main()
