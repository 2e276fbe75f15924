"""Counts documented in FIXTURES.md for sf0.01, plus pipeline invariants."""

import pytest
from pyspark.sql import functions as F

from tiercraft.operators import quality, segment, trend
from tiercraft.plans import catalog
from tiercraft.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


def _counts(df, col="Segment"):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_players_segments(spark):
    seg, _ = segment.segment_players(fx.players(spark, SF))
    assert seg.count() == 1500
    assert _counts(seg) == {"Churned Low Value": 536, "Casual": 453, "VIP High Value": 199,
                            "At Risk High Value": 176, "Active Developing": 136}


def test_players_dirty_shape(spark):
    d = fx.players_dirty(spark, SF)
    got = d.agg(F.count(F.lit(1)).alias("n"),
                F.count_if(F.col("PlayerID").isNull()).alias("null_ids"),
                F.count_if(F.col("PlayerID") == " nan ").alias("nan_ids"),
                F.count_if(F.col("NetADT").isNull()).alias("null_values")).first()
    assert tuple(got) == (1530, 16, 16, 75)


def test_trend_labels(spark):
    cur = fx.current(spark, SF)
    prev = fx.prior(spark, SF)
    assert (cur.count(), prev.count()) == (1492, 1484)
    t = trend.apply_trend(cur, prev, "PlayerID")
    assert _counts(t, "Trend") == {"Rising": 545, "Declining": 491, "Stable": 403,
                                   "No prior data": 53}


def test_companies_segments(spark):
    seg, _ = segment.segment_companies(fx.companies(spark, SF))
    assert seg.count() == 100
    assert _counts(seg) == {"Leveraged Watchlist": 35, "Standard": 21, "Dormant": 19,
                            "Strategic Account": 13, "High Value At Risk": 12}


def test_custom_segments(spark):
    seg, _ = segment.segment_custom(fx.custom(spark, SF), "worth", "recency_days")
    assert seg.count() == 2000
    assert _counts(seg) == {"Mid Tier": 507, "Mid Tier Lapsed": 467, "High Value At Risk": 245,
                            "Low Value": 244, "Low Value Lapsed": 244, "High Value Active": 243,
                            "Needs Review": 50}


def test_offer_sums(spark):
    o = fx.offers(spark, SF)
    assert o.count() == 14743
    row = o.agg(*[F.sum(c).alias(c) for c in
                  ("OfferHotel", "OfferTables", "OfferFood", "OfferSlots")]).first()
    assert tuple(row) == (762398.0, 508966.0, 508542.0, 506627.0)


def test_invariants(spark):
    df = fx.players_dirty(spark, SF)
    kept, rejects = quality.quarantine(df, "PlayerID")
    n_kept, n_rej = kept.count(), rejects.count()
    assert n_kept + n_rej == df.count()
    seg, _ = catalog.players_segmented(spark, SF)
    counts = _counts(seg)
    assert sum(counts.values()) == seg.count() == 1500      # J1 keeps the row count
    shares = catalog.q_segment_overview(spark, SF).collect()
    assert sum(r["Records"] for r in shares) == 1500
    assert abs(sum(int(r["% of value"][:-1]) for r in shares) - 100) <= len(shares)


@pytest.mark.parametrize("mode", ["players", "companies"])
def test_clean_fills_every_value(spark, mode):
    if mode == "players":
        kept, _ = quality.quarantine(fx.players_dirty(spark, SF), "PlayerID")
        res = quality.clean(kept, "NetADT", ("CanEmail",), "ZipCode")
        col = "NetADT"
    else:
        res = quality.clean(fx.companies(spark, SF), "AnnualRevenue", (), "Industry")
        col = "AnnualRevenue"
    assert res.cleaned.where(F.col(col).isNull()).count() == 0


def test_runners_match_catalog_queries(spark):
    from tiercraft.plans import runner
    sf = "/root/testdata/sf0.001"
    comp = runner.run_companies(fx.companies(spark, sf))
    want = {r.AccountID: r.Segment for r in catalog.q_segment_companies(spark, sf).collect()}
    assert {r.AccountID: r.Segment for r in comp.segmented.collect()} == want
    assert [s["Stage"] for s in comp.run_log] == ["Quarantine", "Clean", "Segment",
                                                 "Aggregate"]
    cust = runner.run_custom(fx.custom(spark, sf), "ref_id", "worth", "recency_days")
    want = {r.ref_id: r.Segment for r in catalog.q_segment_custom(spark, sf).collect()}
    assert {r.ref_id: r.Segment for r in cust.segmented.collect()} == want
    assert cust.missing_rate == pytest.approx(
        catalog.q_parse_rate_custom(spark, sf).first().value_unparsed_rate)
    assert [r.line for r in cust.clean_report.collect()] == [
        "Cleaned the worth column into numbers, stripping symbols and commas."]
    comp.release()
    cust.release()


def test_run_result_reports_reuse_stats(spark):
    from tiercraft.operators import rollup
    from tiercraft.plans import runner
    sf = "/root/testdata/sf0.001"
    res = runner.run_players(fx.players_dirty(spark, sf), prev=fx.prior(spark, sf))
    assert res.value_stats[0] == res.segmented.count()
    a = sorted(map(tuple, res.value_bands().collect()))
    b = sorted(map(tuple, rollup.value_bands(res.segmented, "NetADT").collect()))
    assert a == b
    assert res.distribution_insight().first().insight == \
        rollup.distribution_insight(res.segmented, "NetADT").first().insight
    res.release()
