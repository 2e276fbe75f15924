"""Data quality: quarantine (F1), preflight (F8), clean (G6), health (A13-A15),
quarantine metrics (A21), clean report (A22), parse rate (A23)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercraft import config
from tiercraft.functions.columns import col, sentence
from tiercraft.functions.numbers import fmt_fixed, money_value, parse_strict
from tiercraft.functions.text import (consent_standardise, flag_issue, flag_missing,
                                      id_is_missing, normalise_id)
from tiercraft.operators.quantiles import quantiles
from tiercraft.operators.skew import join_hot
from tiercraft.sources.readers import ROW_ORDER

REASON = "QuarantineReason"


def data_columns(df: DataFrame) -> list[str]:
    """User-visible columns (the technical row order is not counted)."""
    return [c for c in df.columns if c != ROW_ORDER]


def lines_frame(df_one_row: DataFrame, lines: list[Column]) -> DataFrame:
    """Turn conditional text columns of a one-row frame into numbered lines;
    NULL entries (conditions not met) are skipped."""
    arr = F.array_compact(F.array(*lines))
    return (df_one_row.select(F.posexplode(arr).alias("line_no", "line"))
            .select((F.col("line_no") + 1).alias("line_no"), "line"))


# --------------------------------------------------------------------------
# F1 quarantine
# --------------------------------------------------------------------------

def classify_identity(df: DataFrame, id_col: str | None) -> DataFrame:
    """Add ``QuarantineReason`` (first column; NULL for kept rows).

    Missing id: NULL or stripped text in {'', 'nan', 'None', 'NaN'}.
    Duplicate: a later row (by ``_row_order``) with the same stripped id, so
    exactly one row per id stays. ``_row_order`` must be unique; the query
    fails if two rows of one id share it, as "first" is then undefined.

    Only (id, row order) pairs are shuffled to find the ids that repeat, with
    their first place; that set is joined back, by the planner's choice of
    join. Rows without an id get keys of their own (no id starts with a
    NUL), so they spread over all partitions; the rows of an id with a million
    rows or more are salted.
    """
    if not id_col or id_col not in df.columns:
        return df.select(F.lit(None).cast("string").alias(REASON), *map(col, df.columns))
    if ROW_ORDER not in df.columns:
        raise ValueError(f"records need a unique {ROW_ORDER} column "
                         "(tiercraft.sources.readers.with_row_order attaches one)")
    dtype = df.schema[id_col].dataType
    # The stripped id is computed once per row, then tested and reused.
    staged = df.withColumn("_qraw", normalise_id(id_col, dtype))
    missing = id_is_missing(id_col, dtype, key=F.col("_qraw"))
    tagged = (staged.withColumn("_qmissing", missing)
              .withColumn("_qkey", F.when(F.col("_qmissing"), F.concat(
                  F.lit("\0"), F.xxhash64(ROW_ORDER).cast("string")))
                  .otherwise(F.coalesce("_qraw", F.lit(""))))
              .drop("_qraw"))
    # No filter on the id here, and no null key for the join to rule out: either would be
    # pushed to the scan, where the stripped id is written out, and computed, dozens of times.
    repeated = (tagged.groupBy("_qkey", ROW_ORDER).agg(F.count(F.lit(1)).alias("_qtied"))
                .groupBy("_qkey").agg(F.min(ROW_ORDER).alias("_qfirst"),
                                      F.sum("_qtied").alias("_qn"),
                                      F.max("_qtied").alias("_qtied"))
                .where(F.col("_qn") > 1))
    joined = join_hot(tagged, repeated, ["_qkey"], "_qn", F.col(ROW_ORDER), how="left")
    tie = F.raise_error(F.lit(f"{ROW_ORDER} is not unique among rows that share a {id_col}"))
    reason = (F.when(F.col("_qmissing"), F.lit(f"Missing {id_col}"))
              .when(F.col("_qtied") > 1, tie.cast("string"))
              .when(F.col(ROW_ORDER) != F.col("_qfirst"),
                    F.lit(f"Duplicate {id_col} (first occurrence kept)")))
    return joined.select(reason.alias(REASON), *map(col, df.columns))


def quarantine(df: DataFrame, id_col: str | None) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects). Rejects carry the reason as their first column."""
    classified = classify_identity(df, id_col)
    kept = classified.where(F.col(REASON).isNull()).drop(REASON)
    rejects = classified.where(F.col(REASON).isNotNull())
    return kept, rejects


def quarantine_metrics(classified: DataFrame) -> DataFrame:
    """Rows received = kept + quarantined, with the split by reason."""
    r = F.col(REASON)
    return classified.agg(
        F.count(F.lit(1)).alias("rows_received"),
        F.count_if(r.isNull()).alias("rows_kept"),
        F.count_if(r.isNotNull()).alias("rows_quarantined"),
        F.count_if(r.startswith("Missing")).alias("missing_ids"),
        F.count_if(r.startswith("Duplicate")).alias("duplicate_ids"))


# --------------------------------------------------------------------------
# F8 preflight
# --------------------------------------------------------------------------

def preflight(df: DataFrame, id_col: str | None, value_col: str | None) -> DataFrame:
    """Concerns as numbered lines: value column >10% unreadable, count of
    missing + duplicate ids, id column absent. One aggregate pass."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    has_value = bool(value_col) and value_col in df.columns
    has_id = bool(id_col) and id_col in df.columns
    if has_value:
        aggs.append(F.avg(money_value(df, value_col).isNull().cast("double")).alias("_miss"))
    if has_id:
        dtype = df.schema[id_col].dataType
        df = df.withColumn("_praw", normalise_id(id_col, dtype))
        missing = id_is_missing(id_col, dtype, key=F.col("_praw"))
        key = F.when(~missing, F.col("_praw"))
        aggs += [F.count_if(missing).alias("_blank"),
                 (F.count(key) - F.count_distinct(key)).alias("_dupe")]
    one = df.agg(*aggs)
    lines = []
    if has_value:
        lines.append(F.when(F.col("_miss") > config.PREFLIGHT_UNREADABLE_LIMIT, sentence(
            config.PREFLIGHT_UNREADABLE, share=fmt_fixed(F.col("_miss") * 100, 0),
            value=value_col)))
    if has_id:
        bad = F.col("_blank") + F.col("_dupe")
        lines.append(F.when(bad > 0, sentence(
            config.PREFLIGHT_BAD_IDS, rows=bad.cast("string"), id=id_col)))
    elif id_col:
        lines.append(sentence(config.PREFLIGHT_NO_ID, id=id_col))
    if not lines:
        return one.select(F.lit(1).alias("line_no"), F.lit("x").alias("line")).limit(0)
    return lines_frame(one, lines)


# --------------------------------------------------------------------------
# G6 clean + A22 report
# --------------------------------------------------------------------------

@dataclass
class CleanResult:
    cleaned: DataFrame
    report: DataFrame        # (line_no, line)
    metrics: DataFrame       # one row: rows, imputed, flagged, median, issue_rate, ...
    median: float | None
    issue_rate: float | None = None   # known once the counts ran (value column present)


def clean(df: DataFrame, value_col: str | None, consent_cols=(), flag_col: str | None = None,
          method: str = "exact") -> CleanResult:
    """Standardise consent columns, parse the value as money and fill its
    gaps with the median, flag missing cells of the flag column."""
    out = df
    report: list[Column] = []
    for c in consent_cols:
        if c in out.columns:
            out = out.withColumn(c, consent_standardise(c))
            report.append(sentence(config.CLEAN_CONSENT, column=c))
    has_value = bool(value_col) and value_col in out.columns
    has_flag = bool(flag_col) and flag_col in out.columns
    med = None
    aggs = [F.count(F.lit(1)).alias("rows")]
    if has_value:
        parsed = money_value(out, value_col)
        out = out.withColumn(value_col, parsed)
        vc = col(value_col)
        aggs += [F.count_if(vc.isNull()).alias("imputed"), F.count(vc).alias("_vn"),
                 F.min(vc).alias("_vmin"), F.max(vc).alias("_vmax")]
    else:
        aggs.append(F.lit(0).cast("bigint").alias("imputed"))
    if has_flag:
        aggs.append(F.count_if(flag_issue(flag_col)).alias("flagged"))
    else:
        aggs.append(F.lit(0).cast("bigint").alias("flagged"))
    # Counts are taken on the pre-fill frame; the fill itself is lazy.
    counted = out.agg(*aggs)
    rate = None
    if has_value:
        stats = counted.first()
        rate = (stats["imputed"] + stats["flagged"]) / max(stats["rows"], 1)
        if stats["imputed"]:
            med = quantiles(out, value_col, {"m": 0.5}, method=method,
                            stats=(stats["_vn"], stats["_vmin"], stats["_vmax"]))["m"]
            out = out.withColumn(value_col, F.coalesce(vc, F.lit(med).cast("double")))
        med_text = "nan" if med is None else f"{med:,.2f}"
        report.append(F.when(F.col("imputed") > 0, sentence(
            config.CLEAN_FILLED, cells=F.col("imputed").cast("string"), column=value_col,
            median=med_text)))
    if has_flag:
        out = out.withColumn(flag_col, flag_missing(flag_col))
        report.append(F.when(F.col("flagged") > 0, sentence(
            config.CLEAN_FLAGGED, cells=F.col("flagged").cast("string"), column=flag_col)))
    issues = F.col("imputed") + F.col("flagged")
    metrics = counted.select(
        "rows", "imputed", "flagged",
        F.lit(med).cast("double").alias("median"),
        (issues / F.greatest(F.col("rows"), F.lit(1))).alias("issue_rate"),
        (F.col("imputed") / F.greatest(F.col("rows"), F.lit(1))).alias("value_unparsed_rate"))
    tidy = F.lit(config.CLEAN_TIDY)
    lines = report + [F.when(F.size(F.array_compact(F.array(*report))) == 0, tidy)
                      if report else tidy]
    return CleanResult(out, lines_frame(counted, lines), metrics, med, rate)


def value_parse_rate(df: DataFrame, value_col: str) -> DataFrame:
    """Share of rows whose value does not parse as money."""
    return df.agg(F.avg(money_value(df, value_col).isNull().cast("double"))
                  .alias("value_unparsed_rate"))


# --------------------------------------------------------------------------
# A13-A15 health (on the raw input)
# --------------------------------------------------------------------------

def _null_cells(df: DataFrame) -> Column:
    cols = data_columns(df)
    if not cols:
        return F.lit(0)
    return sum((F.count_if(col(c).isNull()) for c in cols), F.lit(0))


def _health_head(df: DataFrame, noun: str) -> tuple[list, list[Column]]:
    ncols = len(data_columns(df))
    aggs = [F.count(F.lit(1)).alias("_rows"), _null_cells(df).alias("_nulls")]
    empty = F.col("_nulls") / F.greatest(F.col("_rows") * ncols, F.lit(1)) * 100
    return aggs, [sentence(config.HEALTH_LOADED, rows=F.col("_rows").cast("string"), noun=noun,
                           columns=str(ncols)),
                  sentence(config.HEALTH_EMPTY, share=fmt_fixed(empty, 1))]


def _share(pred: Column) -> Column:
    return F.avg(F.coalesce(pred, F.lit(False)).cast("double")) * 100


def health(df: DataFrame, mode: str, value_col: str | None = None) -> DataFrame:
    """Health lines of the raw input for a mode (players/companies/custom)."""
    noun = "accounts" if mode == "companies" else "records"
    aggs, lines = _health_head(df, noun)
    cols = df.columns

    def share(pred: Column, name: str, template: str, **parts: str) -> None:
        aggs.append(_share(pred).alias(name))
        lines.append(sentence(template, share=fmt_fixed(F.col(name), 0), **parts))

    if mode == "players":
        if "CanEmail" in cols:
            share(F.lower(F.col("CanEmail").cast("string")) == "yes", "_e", config.HEALTH_EMAILABLE)
        if "DaysSinceLastVisit" in cols:
            days = config.PLAYER_RECENCY_LAPSED_DAYS
            share(parse_strict(df, "DaysSinceLastVisit") > days, "_d", config.HEALTH_LAPSED,
                  days=str(days))
    elif mode == "companies":
        if "MonthsSinceContact" in cols:
            months = config.COMPANY_DORMANT_MONTHS
            share(parse_strict(df, "MonthsSinceContact") > months, "_m", config.HEALTH_UNCONTACTED,
                  months=str(months))
        if "RiskTier" in cols:
            share(F.col("RiskTier") == config.HIGH_RISK_TIER, "_r", config.HEALTH_HIGH_RISK,
                  tier=config.HIGH_RISK_TIER)
    else:
        share(money_value(df, value_col).isNotNull(), "_p", config.HEALTH_PARSED)
    return lines_frame(df.agg(*aggs), lines)
