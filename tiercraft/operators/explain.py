"""Per-row explanations (E19-E21), labels (E24) and record lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from tiercraft import config
from tiercraft.functions.columns import col, sentence
from tiercraft.functions.numbers import fmt_int, fmt_money, parse_strict
from tiercraft.functions.text import record_label
from tiercraft.sources.layout import SortedTable
from tiercraft.sources.readers import ROW_ORDER


def _concat_ws(*parts: Column) -> Column:
    """Sentences joined by single spaces; NULL parts (conditions not met)
    are skipped."""
    return F.concat_ws(" ", *parts)


def explain_player(df: DataFrame, cut: float | None, sym: str = "$") -> Column:
    v = parse_strict(df, "NetADT")
    c = F.lit(cut).cast("double")
    figures = {"value": fmt_money(v, sym), "cut": fmt_money(c, sym)}
    parts = [F.when(v >= c, sentence(config.EXPLAIN_PLAYER_HIGH, **figures))
             .otherwise(sentence(config.EXPLAIN_PLAYER_LOW, **figures))]
    if "DaysSinceLastVisit" in df.columns:
        r = parse_strict(df, "DaysSinceLastVisit")
        days, limit = fmt_int(r), config.PLAYER_RECENCY_LAPSED_DAYS
        parts.append(
            F.when(r > limit, sentence(config.EXPLAIN_PLAYER_LAPSED, days=days, limit=str(limit)))
            .when(r <= config.PLAYER_RECENCY_ACTIVE_DAYS,
                  sentence(config.EXPLAIN_PLAYER_RECENT, days=days))
            .when(r.isNotNull(), sentence(config.EXPLAIN_PLAYER_SEEN, days=days)))
    parts.append(sentence(config.EXPLAIN_PLAYER_SEGMENT, segment=F.col("Segment")))
    return F.when(v.isNull(), F.lit(config.EXPLAIN_PLAYER_NONE)).otherwise(_concat_ws(*parts))


def _py_str_double(c: Column) -> Column:
    """Python's str() of a double for the usual range (no exponent form
    between 1e-4 and 1e16)."""
    s = c.cast("string")
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"),
                                              "0+$", ""), r"\.$", ".0")
    a = F.abs(c)
    sci = ((a >= 1e7) & (a < 1e16)) | ((a >= 1e-4) & (a < 1e-3))
    return F.when(F.isnan(c), F.lit("nan")).when(sci, plain).otherwise(s)


def explain_company(df: DataFrame, cut: float | None, sym: str = "$") -> Column:
    rev = parse_strict(df, "AnnualRevenue")
    c = F.lit(cut).cast("double")
    figures = {"value": fmt_money(rev, sym), "cut": fmt_money(c, sym)}
    parts = [F.when(rev >= c, sentence(config.EXPLAIN_COMPANY_HIGH, **figures))
             .otherwise(sentence(config.EXPLAIN_COMPANY_LOW, **figures))]
    if "DebtToEquity" in df.columns:
        d = parse_strict(df, "DebtToEquity")
        limit = config.COMPANY_LEVERAGE_LIMIT
        parts.append(
            F.when(d > limit, sentence(config.EXPLAIN_COMPANY_LEVERAGED, ratio=_py_str_double(d),
                                       limit=str(limit)))
            .when(d.isNotNull(), sentence(config.EXPLAIN_COMPANY_HEALTHY, ratio=_py_str_double(d))))
    if "MonthsSinceContact" in df.columns:
        m = parse_strict(df, "MonthsSinceContact")
        parts.append(F.when(m > config.COMPANY_DORMANT_MONTHS,
                            sentence(config.EXPLAIN_COMPANY_COLD, months=fmt_int(m))))
    parts.append(sentence(config.EXPLAIN_COMPANY_SEGMENT, segment=F.col("Segment")))
    return F.when(rev.isNull(), F.lit(config.EXPLAIN_COMPANY_NONE)).otherwise(_concat_ws(*parts))


def explain_custom(df: DataFrame, cut: float | None, value_col: str, sym: str = "$") -> Column:
    v = parse_strict(df, value_col)
    c = F.lit(cut).cast("double")
    tier = F.when(v >= c, config.EXPLAIN_CUSTOM_TOP).otherwise(config.EXPLAIN_CUSTOM_BELOW)
    return F.when(v.isNull(), sentence(config.EXPLAIN_CUSTOM_NONE, column=value_col)).otherwise(
        sentence(config.EXPLAIN_CUSTOM, column=value_col, value=fmt_money(v, sym), tier=tier,
                 cut=fmt_money(c, sym), segment=F.col("Segment")))


def explain(df: DataFrame, mode: str, cut: float | None, value_col: str | None = None,
            sym: str = "$") -> Column:
    """Explanation dispatch by mode."""
    if mode == "players":
        return explain_player(df, cut, sym)
    if mode == "companies":
        return explain_company(df, cut, sym)
    return explain_custom(df, cut, value_col, sym)


def with_label(df: DataFrame, id_col: str) -> DataFrame:
    """E24: 'FullName (id)' or the id."""
    name = "FullName" if "FullName" in df.columns else None
    return df.withColumn("Label", record_label(name, id_col))


def record_lookup(df: DataFrame, id_col: str, record_id) -> DataFrame:
    """the record with this id (ids are unique after quarantine)."""
    return df.where(col(id_col) == F.lit(record_id))


def lookup_by_name(df: DataFrame, pick: str, id_col: str = "PlayerID") -> DataFrame:
    """the first record (in source order, then by id) whose FullName, or
    without such a column whose id text, is ``pick``."""
    by = col("FullName") if "FullName" in df.columns else col(id_col).cast("string")
    order = [F.col(ROW_ORDER).asc()] if ROW_ORDER in df.columns else []
    return df.where(by == F.lit(pick)).orderBy(*order, col(id_col).asc()).limit(1)


@dataclass(frozen=True)
class StoredRecords:
    """F5, F7 without a scan: the records sorted by id, and their names sorted beside them."""

    records: SortedTable
    names: SortedTable

    @classmethod
    def write(cls, df: DataFrame, id_col: str, path: str, files: int) -> StoredRecords:
        """Store records (ids unique, as the quarantine leaves them) in about ``files`` files."""
        by = "FullName" if "FullName" in df.columns else id_col
        pairs = df.select(col(by).cast("string").alias("name"), col(id_col).alias("id"),
                          (col(ROW_ORDER) if ROW_ORDER in df.columns else F.lit(0)).alias("place"))
        pairs = pairs.withColumn("place", F.struct("place", "id"))
        return cls(SortedTable.write(df, id_col, f"{path}/records", files),
                   SortedTable.write(pairs, "name", f"{path}/names", files, order="place"))

    def by_id(self, spark: SparkSession, record_id) -> DataFrame:
        return self.records.lookup(spark, record_id)

    def by_name(self, spark: SparkSession, pick: str) -> DataFrame:
        """The record that :func:`lookup_by_name` finds."""
        first = self.names.lookup(spark, pick).agg(F.min("place").alias("p")).first()["p"]
        return self.by_id(spark, first["id"] if first else None)


def value_text(df: DataFrame, name: str) -> Column:
    """str() of a cell the way the record detail shows it (missing -> 'nan')."""
    dtype = df.schema[name].dataType
    c = col(name)
    text = _py_str_double(c) if isinstance(dtype, FractionalType) else c.cast("string")
    return F.coalesce(text, F.lit("nan"))


def record_detail(df: DataFrame, id_col: str) -> DataFrame:
    """every record as (id, Field, Value) text rows, fields in column
    order; filter on the id for one record."""
    fields = [c for c in df.columns if c != ROW_ORDER]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("field_no"), F.lit(c).alias("Field"),
                              value_text(df, c).alias("Value"))
                     for i, c in enumerate(fields)])
    return df.select(col(id_col).alias("record_id"), F.inline(rows))
