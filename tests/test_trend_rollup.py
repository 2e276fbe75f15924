"""Trend join, rollups, bands, Pareto, worklist tiers, explanations."""

import numpy as np
from pyspark.sql import functions as F

from tiercraft.config import PLAYER_MEANINGS
from tiercraft.operators import explain, rollup, trend, worklist


def test_trend_edges(spark):
    cur = spark.createDataFrame(
        [("P1", 100.0), ("P2", 50.0), ("P3", -10.0), ("P4", 85.04), ("P5", 114.94),
         ("P6", 80.0), ("P7", 10.0)], "PlayerID string, NetADT double")
    prev = spark.createDataFrame(
        [(" P1", 0.0, 1), ("P2", None, 2), ("P3", -20.0, 3), ("P4", 100.0, 4), ("P5", 100.0, 5),
         ("P6", 100.0, 6), ("P6", 1.0, 7), ("P9", 1.0, 8)],
        "PlayerID string, NetADT double, _row_order long")
    out = trend.apply_trend(cur, prev, "PlayerID")
    assert out.count() == cur.count()
    got = {r.PlayerID: (r.NetADT_Prev, r.TrendPct, r.Trend) for r in out.collect()}
    assert got["P1"] == (0.0, None, "No prior data")
    assert got["P2"] == (None, None, "No prior data")
    assert got["P3"] == (-20.0, -50.0, "Declining")
    assert got["P4"] == (100.0, -15.0, "Declining")      # -14.96 rounds to -15.0
    assert got["P5"] == (100.0, 14.9, "Stable")
    assert got["P6"] == (100.0, -20.0, "Declining")      # first prior row kept
    assert got["P7"] == (None, None, "No prior data")


def test_trend_unchanged_without_columns(spark):
    cur = spark.createDataFrame([("P1", 1.0)], "PlayerID string, NetADT double")
    prev = spark.createDataFrame([("P1", 1.0)], "Other string, NetADT double")
    assert trend.apply_trend(cur, prev, "PlayerID").columns == cur.columns


def _seg(spark):
    rows = [("P1", "Ann", 10.0, "Casual"), ("P2", "Bob", 30.0, "Casual"),
            ("P3", "Cy", 300.0, "VIP High Value"), ("P4", "Di", 100.0, "At Risk High Value"),
            ("P5", "Ed", None, "Needs Review")]
    return spark.createDataFrame(rows, "PlayerID string, FullName string, NetADT double, "
                                       "Segment string")


def test_value_table_counts_and_overview(spark):
    seg = _seg(spark)
    vt = {r.Segment: (r.Records, r.TotalValue, r.AvgValue, r.rank)
          for r in rollup.value_table(seg, "PlayerID", "NetADT").collect()}
    assert vt["Casual"] == (2, 40.0, 20.0, 3)
    assert vt["Needs Review"] == (1, 0.0, None, 4)
    assert vt["VIP High Value"][3] == 1
    counts = {r.Segment: (r.Records, r.Meaning) for r in
              rollup.segment_counts(seg, PLAYER_MEANINGS).collect()}
    assert counts["Casual"] == (2, PLAYER_MEANINGS["Casual"])
    ov = {r.Segment: r for r in rollup.segment_overview(seg, "NetADT").collect()}
    assert ov["Casual"]["% of records"] == "40%"
    assert ov["Casual"]["% of value"] == f"{40 / 440 * 100:.0f}%"
    assert ov["Needs Review"]["Avg value"] == "$nan"
    shares = sum(int(r["% of records"][:-1]) for r in ov.values())
    assert 98 <= shares <= 102


def test_distribution_insight_tie_safe(spark):
    vals = [5.0] * 15 + [1.0] * 5
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    text = rollup.distribution_insight(df, "v").first().insight
    k = max(1, int(len(vals) * 0.1))
    share = sum(sorted(vals, reverse=True)[:k]) / sum(vals) * 100
    assert text.startswith(f"The median value is $5.00 and the top 10% of records hold about "
                           f"{share:.0f}% of total value.")


def test_value_bands_labels(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 6, 7, 8, 9, 10, 11, 12, 13, 14]],
                               "v double")
    bands = rollup.value_bands(df, "v").orderBy("band_no").collect()
    assert bands[0].Band == "$4 to $6"          # lowest edge lowered by 0.001 then truncated
    assert sum(b.Records for b in bands) == 10
    const = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    # one edge makes no quantile band: equal-width bands instead
    fallback = rollup.value_bands(const, "v").orderBy("band_no").collect()
    assert fallback == rollup.width_bands(const, "v").orderBy("band_no").collect()
    assert [b.Records for b in fallback] == [0, 0, 2, 0, 0]
    single = spark.createDataFrame([(3.0,)], "v double")
    assert rollup.value_bands(single, "v").count() == 5
    dup = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 2, 3, 4, 5]], "v double")
    assert rollup.value_bands(dup, "v").count() == 3   # duplicate edges dropped


def test_width_bands(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    bands = rollup.width_bands(df, "v").orderBy("band_no").collect()
    assert [b.Records for b in bands] == [3, 2, 2, 2, 2]
    edges = np.linspace(0, 10, 6)
    assert bands[1].lower == edges[1]


def test_pareto_all_null_and_absent_columns(spark):
    df = spark.createDataFrame([(10.0, None, 5.0), (20.0, None, 1.0)],
                               "OfferSlots double, OfferTables double, OfferFood double")
    rows = rollup.pareto(df).orderBy("rank").collect()
    assert [(r.Category, r.RawTotal, r["Cumulative %"]) for r in rows] == [
        ("OfferSlots", 30.0, 83.3), ("OfferFood", 6.0, 100.0)]
    assert rollup.pareto(df.select(F.lit(1).alias("x"))) is None


def test_comp_tiers(spark):
    df = spark.createDataFrame([(v,) for v in [None, -5.0, 0.0, 49.99, 50.0, 120.0, 260.0]],
                               "v double")
    rows = df.select(worklist.comp_tier(F.col("v")).alias("t"),
                     worklist.comp_band(F.col("v")).alias("b")).collect()
    assert [r.t for r in rows] == ["Free play offer", "Free play offer", "Free play offer",
                                   "Free play offer", "Complimentary meal", "Hotel night on us",
                                   "Suite plus event invite"]
    assert rows[0].b == "Free play offer band"
    assert rows[4].b == "Complimentary meal band (50 to 120)"
    assert rows[6].b == "Suite plus event invite band (above 250)"
    odd = ((0, "A"), (100, "B"), (50, "C"))          # non-monotonic cutoffs
    r = df.where(F.col("v") == 120.0).select(worklist.comp_tier(F.col("v"), odd).alias("t"),
                                            worklist.comp_band(F.col("v"), odd).alias("b")
                                            ).first()
    assert r.t == "C"           # last tier in list order that matches
    assert r.b == "C band (above 50)"   # first band that holds the value


def test_worklist_order_and_columns(spark):
    rows = [("P1", "A", 300.0, 200, "At Risk High Value", -30.0),
            ("P2", "B", 400.0, 5, "VIP High Value", None),
            ("P3", "C", 500.0, 200, "At Risk High Value", 10.0),
            ("P4", "D", 90.0, 5, "Casual", -50.0),
            ("P5", "E", 600.0, None, "VIP High Value", -20.0)]
    seg = spark.createDataFrame(rows, "PlayerID string, FullName string, NetADT double, "
                                      "DaysSinceLastVisit long, Segment string, TrendPct double")
    wl = worklist.host_worklist(seg, id_col="PlayerID").orderBy("rank").collect()
    assert [r.Player for r in wl] == ["A", "C", "E", "B"]
    assert wl[0]["Why reach out"] == ("High value ($300.00/day) and not seen in 200 days. Prime "
                                      "win-back call, reach out before they are gone. Play is "
                                      "down 30% versus the prior period.")
    assert wl[2]["Days since visit"] == "n/a" and wl[2].Trend == "-20%"
    assert wl[3].Trend == "n/a"
    assert wl[1]["Suggested comp"] == "Suite plus event invite"


def test_explanations(spark):
    rows = [("P1", 300.0, 200, "At Risk High Value"), ("P2", 10.0, 20, "Active Developing"),
            ("P3", None, 20, "Needs Review"), ("P4", 10.0, None, "Casual")]
    seg = spark.createDataFrame(rows, "PlayerID string, NetADT double, "
                                      "DaysSinceLastVisit long, Segment string")
    got = {r.PlayerID: r.e for r in seg.select(
        "PlayerID", explain.explain(seg, "players", 100.0).alias("e")).collect()}
    assert got["P1"] == ("Their NetADT of $300.00 is in the top quartile (cutoff $100.00), so "
                         "they count as high value. They have not visited in 200 days, past the "
                         "180 day mark, so recency flags them as drifting away. Together that "
                         "places them in the At Risk High Value segment.")
    assert got["P2"].endswith("They visited 20 days ago, which is recent. Together that places "
                              "them in the Active Developing segment.")
    assert got["P3"] == "This player has no NetADT value, so they were set aside for review."
    assert "visited" not in got["P4"]


def test_worklist_rank_is_the_global_order(spark):
    rows = [(f"P{i}", f"N{i}", float(i % 37) * 10 + 200, i % 300,
             "At Risk High Value" if i % 3 else "VIP High Value", float(i % 11) - 5)
            for i in range(400)]
    seg = spark.createDataFrame(rows, "PlayerID string, FullName string, NetADT double, "
                                      "DaysSinceLastVisit long, Segment string, TrendPct double")
    a = worklist.host_worklist(seg, id_col="PlayerID")
    b = worklist.host_worklist(seg, id_col="PlayerID", rank_partitions=7)
    ra = [(r.rank, r.Player) for r in a.collect()]
    rb = [(r.rank, r.Player) for r in b.collect()]
    assert sorted(ra) == sorted(rb) and sorted(r for r, _ in ra) == list(range(1, 401))
    want = sorted(rows, key=lambda r: (0 if r[4].startswith("At") else 1, r[5], -r[2], r[0]))
    assert [p for _, p in sorted(ra)] == [r[1] for r in want]


def test_deep_dive_and_filters(spark):
    seg = _seg(spark)
    lines, top = rollup.segment_deep_dive(seg, "Casual", "NetADT", "PlayerID", PLAYER_MEANINGS)
    got = [r.line for r in lines.orderBy("line_no").collect()]
    assert got == ["What this segment is: " + PLAYER_MEANINGS["Casual"],
                   "Records: 2  (40% of all records)", "Total NetADT: $40.00",
                   "Average NetADT: $20.00", "Highest NetADT: $30.00", "Lowest NetADT: $10.00"]
    assert [(r.rank, r.Record) for r in top.orderBy("rank").collect()] == [(1, "Bob"), (2, "Ann")]
    assert worklist.high_value(seg).count() == 2
    assert worklist.in_segment(seg, "Casual").count() == 2
    t = seg.withColumn("Trend", F.lit("Declining"))
    assert trend.declining(t).count() == 5


def test_profile_players_top_values(spark):
    rows = [("P1", 10.0, 5, "Gold", None), ("P2", 20.0, 7, "Silver", None),
            ("P3", 30.0, 9, "Gold", None), ("P4", 40.0, 11, "Bronze", None),
            ("P5", 50.0, 13, "Silver", None), ("P6", 60.0, 15, "Alpha", None)]
    seg = spark.createDataFrame(rows, "PlayerID string, NetADT double, DaysSinceLastVisit long, "
                                      "TierRank string, PreferredGame string")
    lines = [r.line for r in rollup.profile(seg, "players").orderBy("line_no").collect()]
    assert lines == ["Total records: 6",
                     "NetADT: avg $35.00, median $35.00, max $60.00",
                     "DaysSinceLastVisit: avg 10, max 15",
                     "TierRank top values: Gold (2), Silver (2), Alpha (1)",
                     "PreferredGame top values: "]


def test_pareto_all_zero_totals(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "OfferSlots double, OfferFood double")
    rows = rollup.pareto(df).orderBy("rank").collect()
    assert [(r.Category, r.RawTotal, r["Cumulative %"]) for r in rows] == [
        ("OfferFood", 0.0, None), ("OfferSlots", 0.0, None)]
    assert rollup.pareto_insight(rollup.pareto(df)).first().insight.startswith(
        "OfferFood alone accounts for nan% of total offer dollars.")
