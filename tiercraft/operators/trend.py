"""Prior-period comparison: J1/J2 join, E11/E12 trend, A20 counts, W6 top
declines, A25 trend insight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercraft.config import (HIGH_VALUE_SEGMENTS, TREND_HIGH_VALUE, TREND_LIMIT_PCT,
                              TREND_LOW_VALUE, TREND_NO_DECLINES)
from tiercraft.functions.columns import col, sentence
from tiercraft.functions.numbers import (fmt_fixed, fmt_money, fmt_pct_signed, money_value,
                                         parse_strict, round_half_even)
from tiercraft.functions.text import normalise_id, shown
from tiercraft.operators.asof import asof_join
from tiercraft.operators.ranking import small_rank
from tiercraft.sources.layout import JOIN_ID, write_bucketed
from tiercraft.sources.readers import ROW_ORDER


def dedupe_prior(prev: DataFrame, id_col: str) -> DataFrame:
    """One prior value per stripped id, the first in source order. An
    aggregate (min_by, combined map-side), so a hot id costs nothing extra."""
    key = normalise_id(id_col, prev.schema[id_col].dataType)
    order = F.col(ROW_ORDER) if ROW_ORDER in prev.columns else F.monotonically_increasing_id()
    return (prev.select(key.alias("_join_id"), money_value(prev, "NetADT").alias("_p"),
                        order.alias("_o"))
            .where(F.col("_join_id").isNotNull())
            .groupBy("_join_id").agg(F.min_by("_p", "_o").alias("NetADT_Prev")))


def trend_label(pct) -> F.Column:
    """E12 on the rounded percent."""
    return (F.when(pct.isNull(), "No prior data")
            .when(pct <= -TREND_LIMIT_PCT, "Declining")
            .when(pct >= TREND_LIMIT_PCT, "Rising")
            .otherwise("Stable"))


def apply_trend(seg: DataFrame, prev: DataFrame, id_col: str) -> DataFrame:
    """Current LEFT JOIN deduplicated prior on the stripped id; adds
    NetADT_Prev, TrendPct = round((cur - prev) / prev * 100, 1) (prior 0
    gives NULL) and Trend. Unchanged when the prior lacks the id or NetADT.
    The join keeps the row count (the prior side is unique per key). Which
    join is left to the planner: the key is unique on both sides after the
    quarantine, so a shuffle join has no skewed partition."""
    if id_col not in prev.columns or "NetADT" not in prev.columns:
        return seg
    p = dedupe_prior(prev, id_col)
    key = normalise_id(id_col, seg.schema[id_col].dataType)
    return _with_change(seg.withColumn("_join_id", key).join(p, "_join_id", "left"), seg).drop("_join_id")


def _with_change(out: DataFrame, seg: DataFrame) -> DataFrame:
    """E11, E12 of the records ``seg`` joined with their ``NetADT_Prev``."""
    cur = parse_strict(seg, "NetADT")
    pct = round_half_even(F.try_divide(cur - F.col("NetADT_Prev"),
                                       F.nullif(F.col("NetADT_Prev"), F.lit(0.0))) * 100, 1)
    return out.withColumn("TrendPct", pct).withColumn("Trend", trend_label(F.col("TrendPct")))


def store_current(seg: DataFrame, id_col: str, table: str, buckets: int, path: str) -> DataFrame:
    """A period's records (ids unique, as the quarantine leaves them) bucketed by stripped id."""
    return write_bucketed(seg, normalise_id(id_col, seg.schema[id_col].dataType), table, buckets, path)


def store_prior(prev: DataFrame, id_col: str, table: str, buckets: int, path: str) -> DataFrame:
    """J2 done once: a prior period's first value per stripped id, bucketed as :func:`store_current` does."""
    first = dedupe_prior(prev, id_col)
    return write_bucketed(first, F.col(JOIN_ID), table, buckets, path)


def apply_trend_stored(current: DataFrame, prior: DataFrame) -> DataFrame:
    """J1 of two stored periods of equal bucket number: bucket meets bucket, no row is exchanged.

    The merge hint keeps the planner from sending a small side to all tasks instead."""
    return _with_change(current.join(prior.hint("merge"), JOIN_ID, "left"), current).drop(JOIN_ID)


def apply_trend_asof(seg: DataFrame, prior: DataFrame, id_col: str, at: str, prior_at: str) -> DataFrame:
    """J1 over several prior periods: each record against the latest prior state of its id at or
    before its own time. Adds NetADT_Prev, PriorDate, TrendPct and Trend as :func:`apply_trend` does."""
    key = normalise_id(id_col, seg.schema[id_col].dataType)
    prior_key = normalise_id(id_col, prior.schema[id_col].dataType)
    out = asof_join(seg, prior, key, at, prior_key, prior_at,
                    {"NetADT_Prev": money_value(prior, "NetADT"), "PriorDate": prior_at})
    return _with_change(out, seg)


def trend_counts(seg: DataFrame) -> DataFrame:
    """Rising / Stable / Declining counts (0 when absent)."""
    t = F.col("Trend")
    return seg.agg(F.count_if(t == "Rising").alias("Rising"),
                   F.count_if(t == "Stable").alias("Stable"),
                   F.count_if(t == "Declining").alias("Declining"))


def declining(seg: DataFrame) -> DataFrame:
    """rows whose trend is Declining."""
    return seg.where(F.col("Trend") == "Declining")


def top_declines(seg: DataFrame, id_col: str = "PlayerID", sym: str = "$", k: int = 10
                 ) -> DataFrame:
    """The k steepest declines (TrendPct ascending, id as tie-break)."""
    dec = declining(seg).withColumn("_tp", parse_strict(seg, "TrendPct"))
    order = [F.asc_nulls_last("_tp"), col(id_col).asc()]
    top = dec.orderBy(*order).limit(k)
    cols = [c for c in ("FullName", id_col, "Segment") if c in seg.columns]
    return top.select(
        *[col(c).cast("string").alias(c) for c in cols],
        fmt_money(F.col("NetADT_Prev"), sym).alias("Prior NetADT"),
        fmt_money(parse_strict(seg, "NetADT"), sym).alias("Current NetADT"),
        fmt_pct_signed(F.col("_tp")).alias("Change"),
        small_rank(order).alias("rank"))


def trend_insight(seg: DataFrame, id_col: str = "PlayerID", sym: str = "$") -> DataFrame:
    """Decliner count, high-value decliners, and the highest-value one."""
    dec = declining(seg)
    cur = parse_strict(seg, "NetADT")
    hv = F.col("Segment").isin(*HIGH_VALUE_SEGMENTS)
    name = shown("FullName" if "FullName" in seg.columns else id_col)
    order = F.col(ROW_ORDER) if ROW_ORDER in seg.columns else col(id_col)
    one = dec.agg(
        F.count(F.lit(1)).alias("n_dec"), F.count_if(hv).alias("n_hv"),
        F.min_by(F.struct(name.alias("name"), cur.alias("cur"),
                          parse_strict(seg, "TrendPct").alias("tp")),
                 F.when(hv, F.struct((-cur).alias("k"), order.alias("o")))).alias("w"))
    decliners = F.col("n_dec").cast("string")
    text = (F.when(F.col("n_dec") == 0, F.lit(TREND_NO_DECLINES))
            .when(F.col("n_hv") > 0, sentence(
                TREND_HIGH_VALUE, name=F.col("w.name"), value=fmt_money(F.col("w.cur"), sym),
                drop=fmt_fixed(F.abs(F.col("w.tp")), 0), decliners=decliners,
                high_value=F.col("n_hv").cast("string")))
            .otherwise(sentence(TREND_LOW_VALUE, decliners=decliners)))
    return one.select(text.alias("insight"))
