"""Column expressions: money parse, strict parse, rounding, formats, text."""

import math

from pyspark.sql import functions as F

from tiercraft.functions import (consent_standardise, days_since, fmt_money, fmt_pct,
                                 fmt_pct_signed, flag_missing, id_is_missing, money_value,
                                 normalise_id, parse_money, parse_strict, round_half_even)


def _col(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")


def test_money_parse_text_edges(spark):
    cases = {"$1,234.50": 1234.5, "(500)": 500.0, "5%": 5.0, "1.5k": 1.5, "1.2.3": None,
             "1-2": None, "-": None, "": None, None: None, "01/15/2026": 1152026.0,
             "1e5": 15.0, "-7.25": -7.25}
    df = _col(spark, list(cases))
    got = [r[0] for r in df.orderBy("i").select(parse_money(F.col("x"))).collect()]
    assert got == list(cases.values())


def test_money_value_numeric_never_goes_through_text(spark):
    df = _col(spark, [12345678.9, 1e16, float("nan"), None], "double")
    got = [r[0] for r in df.orderBy("i").select(money_value(df, "x")).collect()]
    assert got == [12345678.9, 1e16, None, None]


def test_strict_parse(spark):
    df = _col(spark, ["$5", "1,000", " 5 ", "1e5", "inf", "5d", "abc", None])
    got = [r[0] for r in df.orderBy("i").select(parse_strict(df, "x")).collect()]
    assert got[:4] == [None, None, 5.0, 100000.0]
    assert math.isinf(got[4])
    assert got[5:] == [None, None, None]


def test_round_half_even_matches_numpy(spark):
    import numpy as np
    vals = [0.125, 2.675, 12.5, -2.5, -0.4, 1.005, 0.135, 2.5, 3.5]
    df = _col(spark, vals, "double")
    for d in (0, 1, 2):
        got = [r[0] for r in df.orderBy("i").select(round_half_even(F.col("x"), d)).collect()]
        assert got == [float(np.round(v, d)) for v in vals]


def test_formats_match_python(spark):
    vals = [0.125, 2.675, 12.5, -2.5, -0.4, 1234567.891, None]
    df = _col(spark, vals, "double")
    rows = df.orderBy("i").select(fmt_money(F.col("x")), fmt_pct(F.col("x")),
                                  fmt_pct_signed(F.col("x"))).collect()
    for v, (m, p, s) in zip(vals, rows):
        if v is None:
            assert (m, p, s) == ("$nan", "nan%", "nan%")
            continue
        assert m == f"${v:,.2f}"
        assert p == f"{v:.0f}%"
        assert s == f"{v:+.0f}%"


def test_days_since_floors(spark):
    df = spark.createDataFrame([("2024-01-08 10:00:00",), ("2024-01-12 00:00:00",)], "t string")
    got = [r[0] for r in df.select(days_since(F.col("t").cast("timestamp_ntz"),
                                              "2024-01-10 00:00:00")).collect()]
    assert got == [1, -2]


def test_consent_and_flag(spark):
    df = _col(spark, ["yes", " NO ", "y", None, "", "  ", "x"])
    rows = df.orderBy("i").select(consent_standardise(F.col("x")), flag_missing(F.col("x"))
                                  ).collect()
    assert [r[0] for r in rows] == ["Yes", "No", "Unknown", "Unknown", "Unknown", "Unknown",
                                    "Unknown"]
    assert [r[1] for r in rows] == ["yes", " NO ", "y", "MISSING", "MISSING", "  ", "x"]


def test_identity_normalisation(spark):
    df = _col(spark, [None, "", " nan ", "None", "NaN", " P1 ", "P1", "\tP2\n"])
    rows = df.orderBy("i").select(id_is_missing(F.col("x")), normalise_id(F.col("x"))).collect()
    assert [r[0] for r in rows] == [True, True, True, True, True, False, False, False]
    assert [r[1] for r in rows][5:] == ["P1", "P1", "P2"]


def test_integral_double_ids_lose_point_zero(spark):
    from pyspark.sql.types import DoubleType
    df = _col(spark, [1.0, 2.5, None], "double")
    got = [r[0] for r in df.orderBy("i").select(normalise_id(F.col("x"), DoubleType())).collect()]
    assert got == ["1", "2.5", None]


def test_days_since_ignores_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2024-03-09 00:00:00",), ("2024-11-02 00:00:00",)],
                                   "t string")
        got = [r[0] for r in df.select(days_since(F.col("t").cast("timestamp_ntz"),
                                                  "2024-03-12 00:00:00")).collect()]
        assert got == [3, -235]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
