"""Quarantine, preflight, clean, health."""

from pyspark.sql import functions as F

from tiercraft.operators import quality

ROWS = [  # PlayerID, NetADT, CanEmail, ZipCode, _row_order
    (None, 10.0, "yes", "1", 1),
    ("", 20.0, " NO ", None, 2),
    ("nan", 30.0, "y", "", 3),
    ("None", 40.0, None, "  ", 4),
    (" P1 ", None, "Yes", "9", 5),
    ("P1", 60.0, "no", "9", 6),
    ("P2", None, "x", "9", 7),
    ("P3", 80.0, "yes", "9", 8),
    (None, 90.0, "yes", "9", 9),
]
SCHEMA = "PlayerID string, NetADT double, CanEmail string, ZipCode string, _row_order long"


def _df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_quarantine_reasons_and_invariant(spark):
    df = _df(spark)
    kept, rejects = quality.quarantine(df, "PlayerID")
    reasons = {r["_row_order"]: r["QuarantineReason"] for r in rejects.collect()}
    assert reasons == {1: "Missing PlayerID", 2: "Missing PlayerID", 3: "Missing PlayerID",
                       4: "Missing PlayerID", 9: "Missing PlayerID",
                       6: "Duplicate PlayerID (first occurrence kept)"}
    assert sorted(r["_row_order"] for r in kept.collect()) == [5, 7, 8]
    assert kept.count() + rejects.count() == df.count()
    assert rejects.columns[0] == "QuarantineReason"
    # kept rows keep their original (unstripped) id
    assert kept.where(F.col("_row_order") == 5).first()["PlayerID"] == " P1 "


def test_quarantine_computes_the_stripped_id_once_a_row(spark):
    """A filter on the id would be pushed to the scan with the whole expression written out in it."""
    df = spark.range(40).selectExpr("if(id % 4 = 0, null, concat(id % 10, '-x')) AS k",
                                    "if(id < 8, 0, id) AS _row_order", "id AS n")
    # rows without an id may share a row order
    df = df.where("_row_order > 0 OR k IS NULL")
    kept, rejects = quality.quarantine(df, "k")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "ascii" in x]
    first, want = set(), set()
    for i in [0, 4, *range(8, 40)]:
        key = None if i % 4 == 0 else i % 10
        if key is not None and key not in first:
            first.add(key)
            want.add(i)
    assert {r.n for r in kept.collect()} == want
    assert {r.n: r.QuarantineReason.split()[0] for r in rejects.collect()} == {
        i: "Missing" if i % 4 == 0 else "Duplicate" for i in [0, 4, *range(8, 40)] if i not in want}


def test_quarantine_without_id_column_passes_through(spark):
    df = _df(spark).drop("PlayerID")
    kept, rejects = quality.quarantine(df, "PlayerID")
    assert kept.count() == df.count() and rejects.count() == 0


def test_quarantine_metrics(spark):
    m = quality.quarantine_metrics(quality.classify_identity(_df(spark), "PlayerID")).first()
    assert (m.rows_received, m.rows_kept, m.rows_quarantined, m.missing_ids,
            m.duplicate_ids) == (9, 3, 6, 5, 1)


def test_preflight_lines(spark):
    lines = [r.line for r in quality.preflight(_df(spark), "PlayerID", "NetADT")
             .orderBy("line_no").collect()]
    assert lines == [
        "22% of the value column (NetADT) could not be read as numbers. The wrong column may "
        "be mapped.",
        "6 row(s) have a missing or duplicate PlayerID and will be quarantined out of the "
        "analysis."]
    absent = quality.preflight(_df(spark).drop("PlayerID"), "PlayerID", "NetADT")
    assert absent.orderBy("line_no").collect()[-1].line.startswith("The expected ID column")


def test_clean_report_and_fill(spark):
    kept, _ = quality.quarantine(_df(spark), "PlayerID")
    res = quality.clean(kept, "NetADT", ("CanEmail", "CanCall"), "ZipCode")
    lines = [r.line for r in res.report.orderBy("line_no").collect()]
    assert lines == ["Standardized CanEmail to Yes / No / Unknown.",
                     "Filled 2 missing NetADT values with the median (80.00)."]
    got = {r["_row_order"]: (r.NetADT, r.CanEmail) for r in res.cleaned.collect()}
    assert got == {5: (80.0, "Yes"), 7: (80.0, "Unknown"), 8: (80.0, "Yes")}
    assert abs(res.issue_rate - 2 / 3) < 1e-12


def test_clean_flags_blank_but_keeps_whitespace(spark):
    res = quality.clean(_df(spark), None, (), "ZipCode")
    lines = [r.line for r in res.report.orderBy("line_no").collect()]
    assert lines == ["Flagged 3 missing ZipCode values as MISSING."]
    z = {r["_row_order"]: r.ZipCode for r in res.cleaned.collect()}
    assert (z[2], z[3], z[4]) == ("MISSING", "MISSING", "  ")


def test_clean_tidy(spark):
    df = spark.createDataFrame([("a", 1.0)], "id string, v double")
    res = quality.clean(df, "v", (), None)
    assert [r.line for r in res.report.collect()] == [
        "No cleaning issues found. The data was already tidy."]


def test_health_players(spark):
    lines = [r.line for r in quality.health(_df(spark).withColumn("DaysSinceLastVisit",
                                                                   F.lit(200)), "players")
             .orderBy("line_no").collect()]
    assert lines[0] == "9 records loaded across 5 columns."
    assert lines[1] == f"{(2 + 2 + 1 + 1) / 45 * 100:.1f}% of all cells are empty."
    assert lines[2] == f"{4 / 9 * 100:.0f}% are marked emailable."
    assert lines[3] == "100% have not visited in over 180 days."
