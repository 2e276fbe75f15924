"""Segmentation (G1-G5) plus the recency / leverage derivations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from tiercraft.config import (COMPANY_DORMANT_MONTHS, COMPANY_LEVERAGE_LIMIT,
                              PLAYER_RECENCY_ACTIVE_DAYS, PLAYER_RECENCY_LAPSED_DAYS,
                              VALUE_CUT_QUANTILE, VALUE_LOW_QUANTILE)
from tiercraft.functions.columns import col
from tiercraft.functions.dates import days_since, parse_date
from tiercraft.functions.numbers import money_value, parse_strict, round_half_even
from tiercraft.operators.quantiles import multi_quantiles, quantiles


def _numeric(df: DataFrame, name: str) -> Column:
    return parse_strict(df, name)


def value_cut(df: DataFrame, value_col: str, method: str = "exact",
              stats: tuple | None = None) -> float | None:
    """G1: linear-interpolated 0.75 quantile of the non-null values."""
    return quantiles(df, value_col, {"cut": VALUE_CUT_QUANTILE}, method=method,
                     stats=stats)["cut"]


def derive_days_since_visit(df: DataFrame, as_of: datetime | str | None) -> DataFrame:
    """E5: DaysSinceLastVisit from LastVisitDate when only the date exists."""
    if "DaysSinceLastVisit" in df.columns or "LastVisitDate" not in df.columns:
        return df
    if as_of is None:
        raise ValueError("as_of is required to derive DaysSinceLastVisit from LastVisitDate")
    ts = parse_date(F.col("LastVisitDate"), df.schema["LastVisitDate"].dataType)
    return (df.withColumn("LastVisitDate", ts)
            .withColumn("DaysSinceLastVisit", days_since(F.col("LastVisitDate"), as_of)))


def segment_players(df: DataFrame, as_of: datetime | str | None = None,
                    method: str = "exact", value_stats: tuple | None = None
                    ) -> tuple[DataFrame, float | None]:
    """G2. Needs Review (no value); recency > 180: At Risk High Value if
    value >= cut else Churned Low Value; value >= cut: VIP High Value;
    recency <= 30: Active Developing; else Casual. A NULL recency falls
    through to VIP / Casual; an absent recency column counts as 0."""
    df = derive_days_since_visit(df, as_of)
    if not isinstance(df.schema["NetADT"].dataType, DoubleType):
        value_stats = None      # caller's stats were not taken on parsed values
    df = df.withColumn("NetADT", money_value(df, "NetADT"))
    cut = value_cut(df, "NetADT", method, value_stats)
    v = F.col("NetADT")
    r = _numeric(df, "DaysSinceLastVisit") if "DaysSinceLastVisit" in df.columns else F.lit(0)
    c = F.lit(cut).cast("double")
    seg = (F.when(v.isNull(), "Needs Review")
           .when(r > PLAYER_RECENCY_LAPSED_DAYS,
                 F.when(v >= c, "At Risk High Value").otherwise("Churned Low Value"))
           .when(v >= c, "VIP High Value")
           .when(r <= PLAYER_RECENCY_ACTIVE_DAYS, "Active Developing")
           .otherwise("Casual"))
    return df.withColumn("Segment", seg), cut


def debt_to_equity(df: DataFrame) -> DataFrame:
    """round(debt / equity, 2), equity 0 gives NULL; only when both exist."""
    if "Debt" not in df.columns or "Equity" not in df.columns:
        return df
    d = money_value(df, "Debt")
    e = F.nullif(money_value(df, "Equity"), F.lit(0.0))
    return df.withColumn("DebtToEquity", round_half_even(F.try_divide(d, e), 2))


def segment_companies(df: DataFrame, method: str = "exact", value_stats: tuple | None = None
                      ) -> tuple[DataFrame, float | None]:
    """G3. Needs Review (no revenue); D/E > 1.5: High Value At Risk if
    revenue >= cut else Leveraged Watchlist; revenue >= cut: Strategic
    Account; > 12 months without contact: Dormant; else Standard."""
    if "AnnualRevenue" in df.columns:
        if not isinstance(df.schema["AnnualRevenue"].dataType, DoubleType):
            value_stats = None
        df = df.withColumn("AnnualRevenue", money_value(df, "AnnualRevenue"))
    cut = value_cut(df, "AnnualRevenue", method, value_stats)
    df = debt_to_equity(df)
    rev = F.col("AnnualRevenue")
    dte = F.col("DebtToEquity") if "DebtToEquity" in df.columns else F.lit(0)
    cold = _numeric(df, "MonthsSinceContact") if "MonthsSinceContact" in df.columns else F.lit(0)
    c = F.lit(cut).cast("double")
    seg = (F.when(rev.isNull(), "Needs Review")
           .when(dte > COMPANY_LEVERAGE_LIMIT,
                 F.when(rev >= c, "High Value At Risk").otherwise("Leveraged Watchlist"))
           .when(rev >= c, "Strategic Account")
           .when(cold > COMPANY_DORMANT_MONTHS, "Dormant")
           .otherwise("Standard"))
    return df.withColumn("Segment", seg), cut


def custom_recency(df: DataFrame, recency_col: str, as_of: datetime | str | None) -> Column:
    """The recency column read as money; if no row parses, read as dates
    and turned into days since ``as_of``."""
    parsed = money_value(df, recency_col)
    if isinstance(df.schema[recency_col].dataType, NumericType):
        return parsed          # numbers never need the date reading (no pass)
    n_parsed = df.agg(F.count(parsed).alias("n")).first()["n"]
    if n_parsed:
        return parsed
    if as_of is None:
        raise ValueError("as_of is required to turn a date recency column into days")
    return days_since(parse_date(F.col(recency_col), df.schema[recency_col].dataType),
                      as_of).cast("double")


def segment_custom(df: DataFrame, value_col: str, recency_col: str | None = None,
                   approach: str = "Value + Recency", as_of: datetime | str | None = None,
                   method: str = "exact") -> tuple[DataFrame, float | None]:
    """G4 (value + recency) / G5 (value only). Stale = recency above its
    median. Value >= q75: High Value ...; value <= q25: Low Value ...;
    else Mid Tier ... (value only: Top / Bottom / Middle Tier)."""
    df = df.withColumn(value_col, money_value(df, value_col))
    use_recency = bool(recency_col) and recency_col in df.columns
    if use_recency:
        df = df.withColumn("_recency", custom_recency(df, recency_col, as_of))
    specs = {"cut": (value_col, VALUE_CUT_QUANTILE), "low": (value_col, VALUE_LOW_QUANTILE)}
    with_recency = approach == "Value + Recency" and use_recency
    if with_recency:
        specs["med"] = ("_recency", 0.5)
    q = multi_quantiles(df, specs, method=method)
    cut, low = q["cut"], q["low"]
    v = col(value_col)
    c, lo = F.lit(cut).cast("double"), F.lit(low).cast("double")
    if with_recency:
        med = q["med"]
        stale = F.coalesce(F.col("_recency") > F.lit(med).cast("double"), F.lit(False))
        seg = (F.when(v.isNull(), "Needs Review")
               .when(v >= c, F.when(stale, "High Value At Risk").otherwise("High Value Active"))
               .when(v <= lo, F.when(stale, "Low Value Lapsed").otherwise("Low Value"))
               .otherwise(F.when(stale, "Mid Tier Lapsed").otherwise("Mid Tier")))
    else:
        seg = (F.when(v.isNull(), "Needs Review")
               .when(v >= c, "Top Tier")
               .when(v <= lo, "Bottom Tier")
               .otherwise("Middle Tier"))
    return df.withColumn("Segment", seg), cut
