"""Named queries over the test tables: one per operator of the inventory.

Each query takes (spark, sf_dir) and returns a lazy DataFrame. Record tables
are derived from the given tables by Spark (``tiercraft.sources.fixtures``),
so the work of every query grows with the input. Order-bearing outputs carry
a ``rank`` column; integer outputs are 64-bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiercraft.config import (COMPANIES, COMPANY_PROFILE_TOP, CUSTOM_MEANINGS,
                              DEFAULT_COMP_TIERS, PLAYER_MEANINGS, PLAYERS)
from tiercraft.functions.columns import col
from tiercraft.functions.dates import day_first_columns, days_since, parse_date, unparsed_share
from tiercraft.functions.numbers import parse_money, parse_strict
from tiercraft.operators import bands, heavy_hitters, intake, mapping, quality, rollup, segment, trend, worklist
from tiercraft.operators import explain as ex
from tiercraft.operators import quantile_summaries as summaries
from tiercraft.operators.quantiles import multi_quantiles
from tiercraft.plans import runner
from tiercraft.plans.export import publish_run, published
from tiercraft.plans.report import summary_report
from tiercraft.plans.sql import default_query, run_sql
from tiercraft.session import ensure_checkpoint_dir
from tiercraft.sources import fixtures as fx
from tiercraft.sources.readers import ROW_ORDER, read_records
from tiercraft.sources.sinks import preview, write_csv, write_template
from tiercraft.sources.sinks import roster as roster_of
from tiercraft.sources.split_csv import read_split_csv

def _long(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


# --------------------------------------------------------------------------
# shared derivations
# --------------------------------------------------------------------------

def _stored(df: DataFrame) -> DataFrame:
    """A derived table written once to the checkpoint folder: the selections of
    cut points and the query itself then read it instead of deriving it anew."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def players_segmented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    """fx_players -> quarantine -> clean -> segment -> trend vs fx_prior."""
    kept, _ = quality.quarantine(fx.players(spark, sf_dir), PLAYERS.id_col)
    cleaned = quality.clean(_stored(kept), PLAYERS.value_col, PLAYERS.consent_cols,
                            PLAYERS.flag_col)
    seg, cut = segment.segment_players(cleaned.cleaned)
    return trend.apply_trend(seg, fx.prior(spark, sf_dir), PLAYERS.id_col), cut


def dirty_clean(spark: SparkSession, sf_dir: str) -> quality.CleanResult:
    kept, _ = quality.quarantine(fx.players_dirty(spark, sf_dir), PLAYERS.id_col)
    return quality.clean(_stored(kept), PLAYERS.value_col, PLAYERS.consent_cols, PLAYERS.flag_col)


def companies_segmented(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    kept, _ = quality.quarantine(fx.companies(spark, sf_dir), COMPANIES.id_col)
    cleaned = quality.clean(_stored(kept), COMPANIES.value_col, COMPANIES.consent_cols,
                            COMPANIES.flag_col)
    return segment.segment_companies(cleaned.cleaned)


def custom_segmented(spark: SparkSession, sf_dir: str, approach: str = "Value + Recency"
                     ) -> tuple[DataFrame, float]:
    kept, _ = quality.quarantine(fx.custom(spark, sf_dir), "ref_id")
    return segment.segment_custom(_stored(kept), "worth", "recency_days", approach)


# --------------------------------------------------------------------------
# queries
# --------------------------------------------------------------------------

def q_money_parse(spark, sf_dir):
    c = fx.custom(spark, sf_dir)
    return c.select("ref_id", "worth", parse_money(F.col("worth")).alias("worth_value"))


def q_quarantine_kept(spark, sf_dir):
    kept, _ = quality.quarantine(fx.players_dirty(spark, sf_dir), "PlayerID")
    return kept


def q_quarantine_rejects(spark, sf_dir):
    _, rejects = quality.quarantine(fx.players_dirty(spark, sf_dir), "PlayerID")
    return rejects


def q_quarantine_metrics(spark, sf_dir):
    return quality.quarantine_metrics(
        quality.classify_identity(fx.players_dirty(spark, sf_dir), "PlayerID"))


def q_preflight(spark, sf_dir):
    return _long(quality.preflight(fx.players_dirty(spark, sf_dir), "PlayerID", "NetADT"),
                 "line_no")


def q_clean_players(spark, sf_dir):
    return dirty_clean(spark, sf_dir).cleaned


def q_clean_report(spark, sf_dir):
    return _long(dirty_clean(spark, sf_dir).report, "line_no")


def q_preview(spark, sf_dir):
    """The first 10 input rows in source order (the limit is the feature)."""
    return preview(fx.players_dirty(spark, sf_dir), 10)


def q_rejects_shown(spark, sf_dir):
    """The first 20 quarantined rows as shown (reason first)."""
    _, rejects = quality.quarantine(fx.players_dirty(spark, sf_dir), "PlayerID")
    return preview(rejects, 20)


def q_clean_metrics(spark, sf_dir):
    """Counts, median used and both rates of the clean step."""
    return dirty_clean(spark, sf_dir).metrics


def q_parse_rate_custom(spark, sf_dir):
    """Share of custom values that do not parse as money."""
    return quality.value_parse_rate(fx.custom(spark, sf_dir), "worth")


def q_segment_players(spark, sf_dir):
    seg, _ = segment.segment_players(fx.players(spark, sf_dir))
    return seg.select("PlayerID", "NetADT", "DaysSinceLastVisit", "Segment")


def q_segment_players_dirty(spark, sf_dir):
    seg, _ = segment.segment_players(dirty_clean(spark, sf_dir).cleaned)
    return seg.select("PlayerID", "NetADT", "DaysSinceLastVisit", "CanEmail", "ZipCode",
                      "Segment", ROW_ORDER)


def q_segment_companies(spark, sf_dir):
    seg, _ = companies_segmented(spark, sf_dir)
    return seg.select("AccountID", "AnnualRevenue", "DebtToEquity", "MonthsSinceContact",
                      "Industry", "Segment")


def q_segment_custom(spark, sf_dir):
    seg, _ = custom_segmented(spark, sf_dir)
    return seg.select("ref_id", "worth", "_recency", "Segment")


def q_segment_custom_value_only(spark, sf_dir):
    seg, _ = custom_segmented(spark, sf_dir, "Value only")
    return seg.select("ref_id", "worth", "Segment")


def q_segment_lines(spark, sf_dir):
    """Custom mode (value + recency) over every order line."""
    kept, _ = quality.quarantine(fx.lines(spark, sf_dir), "line_id")
    seg, _ = segment.segment_custom(_stored(kept.drop(ROW_ORDER)), "amount", "days_since_ship")
    return seg.select("line_id", "amount", "_recency", "Segment")


def q_quarantine_lines_rejects(spark, sf_dir):
    """F1 on the largest table, in which many ids repeat: the later rows."""
    _, rejects = quality.quarantine(fx.lines(spark, sf_dir), "line_id")
    return rejects.select("QuarantineReason", "line_id", "amount", "days_since_ship")


def q_line_quantiles(spark, sf_dir):
    """G1 over every order line: three cuts of two columns from one selection."""
    lines = fx.lines(spark, sf_dir)
    q = multi_quantiles(lines, {"cut": ("amount", 0.75), "low": ("amount", 0.25),
                                "median_days": ("days_since_ship", 0.5)})
    return lines.agg(F.count(F.lit(1)).alias("records"),
                     *[F.lit(v).cast("double").alias(k) for k, v in q.items()])


def q_mapping_fallback(spark, sf_dir):
    return _long(mapping.value_candidates(fx.custom(spark, sf_dir)),
                 "ordinal", "rank")


def q_column_profile(spark, sf_dir):
    return _long(mapping.column_profile(fx.custom(spark, sf_dir)), "ordinal")


def q_segment_counts(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(rollup.segment_counts(seg, PLAYER_MEANINGS), "rank")


def q_value_table(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(rollup.value_table(seg, "PlayerID", "NetADT"), "rank")


def q_value_table_companies(spark, sf_dir):
    seg, _ = companies_segmented(spark, sf_dir)
    return _long(rollup.value_table(seg, "AccountID", "AnnualRevenue", with_mean=False), "rank")


def q_segment_overview(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(rollup.segment_overview(seg, "NetADT"), "rank")


def q_segment_stats(spark, sf_dir):
    seg, _ = custom_segmented(spark, sf_dir)
    return rollup.segment_stats(seg, "worth", CUSTOM_MEANINGS)


def q_headline(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return rollup.headline(seg, "NetADT")


def q_segment_insight(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return rollup.segment_insight(rollup.value_table(seg, "PlayerID", "NetADT"))


def q_distribution_insight(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return rollup.distribution_insight(seg, "NetADT")


def q_value_bands(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(rollup.value_bands(seg, "NetADT"), "band_no")


def q_value_bands_custom(spark, sf_dir):
    seg, _ = custom_segmented(spark, sf_dir)
    return _long(rollup.value_bands(seg, "worth"), "band_no")


def q_width_bands(spark, sf_dir):
    seg, _ = companies_segmented(spark, sf_dir)
    return _long(rollup.width_bands(seg, "AnnualRevenue"), "band_no")


def q_pareto(spark, sf_dir):
    return _long(rollup.pareto(fx.offers(spark, sf_dir)), "rank")


def q_pareto_insight(spark, sf_dir):
    return rollup.pareto_insight(rollup.pareto(fx.offers(spark, sf_dir)))


def q_health_players(spark, sf_dir):
    return _long(quality.health(fx.players_dirty(spark, sf_dir), "players"), "line_no")


def q_health_companies(spark, sf_dir):
    return _long(quality.health(fx.companies(spark, sf_dir), "companies"), "line_no")


def q_health_custom(spark, sf_dir):
    return _long(quality.health(fx.custom(spark, sf_dir), "custom", "worth"), "line_no")


def q_profile_players(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(rollup.profile(seg, "players"), "line_no")


def q_profile_companies(spark, sf_dir):
    seg, _ = companies_segmented(spark, sf_dir)
    return _long(rollup.profile(seg, "companies"), "line_no")


def q_profile_custom(spark, sf_dir):
    seg, _ = custom_segmented(spark, sf_dir)
    return _long(rollup.profile(seg, "custom", "worth"), "line_no")


def q_top_categories(spark, sf_dir):
    seg, _ = companies_segmented(spark, sf_dir)
    return _long(rollup.top_categories(seg, COMPANY_PROFILE_TOP), "rank")


def q_trend(spark, sf_dir):
    seg, _ = segment.segment_players(fx.current(spark, sf_dir))
    t = trend.apply_trend(seg, fx.prior(spark, sf_dir), "PlayerID")
    return t.select("PlayerID", "NetADT", "Segment", "NetADT_Prev", "TrendPct", "Trend")


def q_trend_counts(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return trend.trend_counts(seg)


def q_top_declines(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(trend.top_declines(seg, "PlayerID"), "rank")


def q_trend_insight(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return trend.trend_insight(seg, "PlayerID")


def q_top_per_segment(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(worklist.top_per_segment(seg, "NetADT", "PlayerID"), "rank")


def q_top_records(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(worklist.top_records(seg, "NetADT", "PlayerID"), "rank")


def q_worklist(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(worklist.host_worklist(seg, id_col="PlayerID"), "rank")


def q_comp_reason(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    v = F.col("NetADT")
    return seg.select("PlayerID", worklist.comp_tier(v, DEFAULT_COMP_TIERS).alias("comp"),
                      worklist.comp_band(v, DEFAULT_COMP_TIERS).alias("band"),
                      worklist.comp_reason(v, DEFAULT_COMP_TIERS).alias("reason"))


def q_explain_players(spark, sf_dir):
    seg, cut = players_segmented(spark, sf_dir)
    labelled = ex.with_label(seg, "PlayerID")
    return labelled.select("PlayerID", "Label", ex.explain(seg, "players", cut)
                           .alias("Explanation"))


def q_explain_companies(spark, sf_dir):
    seg, cut = companies_segmented(spark, sf_dir)
    return seg.select("AccountID", ex.explain(seg, "companies", cut).alias("Explanation"))


def q_explain_custom(spark, sf_dir):
    seg, cut = custom_segmented(spark, sf_dir)
    return seg.select("ref_id", ex.explain(seg, "custom", cut, "worth").alias("Explanation"))


def q_record_detail(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return _long(ex.record_detail(seg.drop("_recency"), "PlayerID"), "field_no")


def q_roster(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return roster_of(seg, "PlayerID", "NetADT")


def q_sql_records(spark, sf_dir):
    seg, _ = players_segmented(spark, sf_dir)
    return run_sql(spark, seg, default_query("NetADT"))


# -- text and dates as people write them -------------------------------------

def q_strict_parse(spark, sf_dir):
    """E2 on text cells."""
    t = fx.texts(spark, sf_dir)
    return t.select("ref_id", "cell", parse_strict(t, "cell").alias("number"))


def q_parse_dates(spark, sf_dir):
    """The date forms people write."""
    d = fx.dated(spark, sf_dir)
    return d.select("PlayerID", "LastVisitDate",
                    F.date_format(parse_date("LastVisitDate"), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


def q_date_unparsed_rate(spark, sf_dir):
    return unparsed_share(fx.dated(spark, sf_dir), "LastVisitDate")


def q_days_since(spark, sf_dir):
    """Floored whole days up to a fixed instant."""
    d = fx.dated(spark, sf_dir)
    return d.select("PlayerID", days_since(parse_date("LastVisitDate"), fx.AS_OF).alias("days"))


def q_segment_players_from_dates(spark, sf_dir):
    """E5: recency derived from a date column."""
    seg, _ = segment.segment_players(_stored(fx.dated(spark, sf_dir)), as_of=fx.AS_OF)
    return seg.select("PlayerID", "NetADT", "DaysSinceLastVisit", "Segment")


def q_segment_custom_from_dates(spark, sf_dir):
    """A recency column that holds only dates."""
    iso = fx.dated(spark, sf_dir).withColumn("LastVisitDate", F.when(
        F.col(ROW_ORDER) % 7 != 5, F.date_format(parse_date("LastVisitDate"), "yyyy-MM-dd")))
    seg, _ = segment.segment_custom(_stored(iso), "NetADT", "LastVisitDate", as_of=fx.AS_OF)
    return seg.select("PlayerID", "NetADT", "_recency", "Segment")


# -- names with dots, numeric flags, missing names ----------------------------

def q_custom_dotted(spark, sf_dir):
    """Quarantine to segment on columns whose names hold dots."""
    kept, _ = quality.quarantine(fx.dotted(spark, sf_dir), "Member No.")
    seg, _ = segment.segment_custom(_stored(kept), "Net.Worth", "Days.Since")
    return seg.select(col("Member No.").alias("member"), col("Net.Worth").alias("worth"),
                      "_recency", "Segment")


def q_health_dotted(spark, sf_dir):
    return _long(quality.health(fx.dotted(spark, sf_dir), "custom", "Net.Worth"), "line_no")


def q_profile_dotted(spark, sf_dir):
    kept, _ = quality.quarantine(fx.dotted(spark, sf_dir), "Member No.")
    return _long(rollup.profile(_stored(kept), "custom", "Net.Worth"), "line_no")


def q_mapping_guess(spark, sf_dir):
    """G7, with G8 for the value: no name says which column holds it."""
    d = (fx.dotted(spark, sf_dir).withColumnsRenamed({"Net.Worth": "Takings", "Days.Since": "Days Away"})
         .withColumn("Visits", F.col(ROW_ORDER) % 7))
    guess = dict(zip(("id", "value", "recency"), mapping.guess_mapping(d), strict=True))
    return d.agg(F.count(F.lit(1)).alias("records"),
                 *[F.lit(v).cast("string").alias(f"{k}_column") for k, v in guess.items()])


def q_label_null_name(spark, sf_dir):
    """A missing name reads 'nan'."""
    d = fx.players(spark, sf_dir).withColumn("FullName", F.when(
        F.col(ROW_ORDER) % 3 != 0, F.col("FullName")))
    return ex.with_label(d, "PlayerID").select("PlayerID", "Label")


def q_top_records_null_name(spark, sf_dir):
    d = fx.players(spark, sf_dir).withColumn("FullName", F.lit(None).cast("string"))
    return _long(worklist.top_records(d, "NetADT", "PlayerID"), "rank")


def q_flag_numeric(spark, sf_dir):
    """E8 on an integer column, as Parquet input has it."""
    d = fx.players(spark, sf_dir).withColumn("ZipCode", F.when(
        F.col(ROW_ORDER) % 5 != 0, F.col(ROW_ORDER) % 1000))
    res = quality.clean(_stored(d), "NetADT", (), "ZipCode")
    return res.cleaned.select("PlayerID", "ZipCode")


# -- filters, lookups, reports --------------------------------------------------

def q_in_segment(spark, sf_dir):
    """F3."""
    seg, _ = players_segmented(spark, sf_dir)
    return worklist.in_segment(seg, "Casual").select("PlayerID", "NetADT", "Segment")


def q_record_lookup(spark, sf_dir):
    """F5."""
    seg, _ = players_segmented(spark, sf_dir)
    return ex.record_lookup(seg, "PlayerID", "P1").select("PlayerID", "FullName", "Segment")


def q_lookup_by_name(spark, sf_dir):
    """one record although names repeat."""
    d = fx.players(spark, sf_dir).withColumn("FullName", F.concat(
        F.lit("Name "), (F.col(ROW_ORDER) % 10).cast("string")))
    return ex.lookup_by_name(d, "Name 3").select("PlayerID", "FullName")


def q_deep_dive_lines(spark, sf_dir):
    """A5: one segment's numbered lines."""
    seg, _ = custom_segmented(spark, sf_dir)
    lines, _ = rollup.segment_deep_dive(seg, "Mid Tier", "worth", "ref_id", CUSTOM_MEANINGS)
    return _long(lines, "line_no")


def q_deep_dive_top(spark, sf_dir):
    seg, _ = custom_segmented(spark, sf_dir)
    _, top = rollup.segment_deep_dive(seg, "Mid Tier", "worth", "ref_id", CUSTOM_MEANINGS)
    return _long(top, "rank")


def q_profile_players_categories(spark, sf_dir):
    """A16 with its categorical columns."""
    seg = fx.players(spark, sf_dir).withColumn("TierRank", F.concat(
        F.lit("T"), (F.col(ROW_ORDER) % 4).cast("string"))).withColumn("PreferredGame", F.when(
            F.col(ROW_ORDER) % 3 != 0, F.concat(F.lit("G"), (F.col(ROW_ORDER) % 5).cast("string"))))
    return _long(rollup.profile(_stored(seg), "players"), "line_no")


def q_run_log(spark, sf_dir):
    """Stages with their rows (the seconds differ from run to run)."""
    res = runner.run_players(fx.players_dirty(spark, sf_dir), prev=fx.prior(spark, sf_dir))
    try:
        return res.log_frame().drop("Seconds")
    finally:
        res.release()


def q_summary_report(spark, sf_dir):
    """S10 as numbered lines."""
    seg, _ = players_segmented(spark, sf_dir)
    health = quality.health(fx.players(spark, sf_dir), "players")
    lines = summary_report(PLAYERS.title, health, rollup.value_table(seg, "PlayerID", "NetADT"))
    return lines.select((F.row_number().over(Window.orderBy("line_no"))).cast("bigint")
                        .alias("line_no"), "line")


def q_csv_roundtrip(spark, sf_dir):
    """Awkward cells written as CSV and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(fx.awkward(spark, sf_dir), path)
    return read_records(spark, path).drop(ROW_ORDER)


def q_segmented_csv(spark, sf_dir):
    """Records written as CSV, read back and run through."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(fx.players(spark, sf_dir).drop(ROW_ORDER), path)
    seg, _ = segment.segment_players(_stored(read_records(spark, path)))
    return seg.select("PlayerID", "NetADT", "Segment")


def q_template(spark, sf_dir):
    """A header-only file, described by its columns."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    d = fx.players(spark, sf_dir).drop(ROW_ORDER)
    write_template(d, path)
    back = spark.read.option("header", "true").csv(path)
    return d.agg(F.count(F.lit(1)).alias("records"),
                 F.lit(",".join(back.columns)).alias("header"),
                 F.lit(back.count()).cast("bigint").alias("template_rows"))


def q_trend_prior_duplicates(spark, sf_dir):
    """Of a prior period's repeated ids the first row counts."""
    prior = fx.prior(spark, sf_dir)
    later = prior.select(F.concat(F.lit(" "), "PlayerID").alias("PlayerID"),
                         (F.col("NetADT") * 2).alias("NetADT"),
                         (F.col(ROW_ORDER) + F.lit(fx.COPY_ORDER)).alias(ROW_ORDER))
    seg, _ = segment.segment_players(_stored(fx.current(spark, sf_dir)))
    t = trend.apply_trend(seg, later.unionByName(prior), "PlayerID")
    return t.select("PlayerID", "NetADT_Prev", "TrendPct", "Trend")


def q_value_bands_constant(spark, sf_dir):
    """A9 where no quantile edges can be told apart: A10's bands (the parts of the most frequent price)."""
    d = fx.table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("v"))
    often = d.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(1)
    return _long(rollup.value_bands(_stored(d.join(often.select("v"), "v")), "v"), "band_no")


# -- several periods, tier tables, arrivals, split files ----------------------

def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as dated records, and the quarter totals of their ids as prior states; a third of all
    orders have one id."""
    k = F.col("o_custkey")
    orders = (fx.table(spark, sf_dir, "orders")
              .select(F.col("o_orderkey"), F.when(k % 3 == 0, " house").otherwise(F.concat(F.lit("P"), k.cast("string")))
                      .alias("PlayerID"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("NetADT")))
    closing = F.add_months(F.trunc("day", "quarter"), 3)
    prior = (orders.groupBy(F.trim("PlayerID").alias("PlayerID"), closing.alias("closed"))
             .agg((F.sum(F.round(F.col("NetADT") * 100).cast("bigint")) / 100.0).alias("NetADT")))
    return orders, prior


def q_trend_asof(spark, sf_dir):
    """J1, E11, E12 over many prior periods: the latest quarter closed before each order."""
    orders, prior = _states(spark, sf_dir)
    t = trend.apply_trend_asof(orders, prior, "PlayerID", "day", "closed")
    return t.select("o_orderkey", "PlayerID", "NetADT", F.col("PriorDate").cast("string").alias("PriorDate"),
                    "NetADT_Prev", "TrendPct", "Trend")


def q_tier_table(spark, sf_dir):
    """E15, J4 with the tiers of each property in a table: orders against their market's cutoffs."""
    market = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                        F.col("c_mktsegment").alias("property"))
    orders = (fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
              .join(market, "o_custkey"))
    step = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    tiers = orders.groupBy("property", F.col("o_orderpriority").alias("offer"), step.alias("step")).agg(
        F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div (count(1) * 250)").alias("cents"))
    tiers = bands.with_upper(tiers.select("property", "offer", (F.col("cents") * F.col("step")).cast("double").alias("low")),
                             "low", ["property"])
    placed = bands.band_join(orders.select("o_orderkey", F.col("property").alias("market"), "o_totalprice"),
                             tiers, F.col("o_totalprice") - 1000.0, {"market": "property"})
    return placed.select("o_orderkey", "market", "offer", "low", "high")


def q_quarantine_arrivals(spark, sf_dir):
    """F1, W1 of data that arrives in three parts, the second of them twice."""
    index = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    rows = _stored(fx.players_dirty(spark, sf_dir))
    part = F.when(F.col(ROW_ORDER) >= fx.COPY_ORDER, 2).otherwise((F.col(ROW_ORDER) % 2).cast("int"))
    judged = {}
    for arrival in (0, 1, 2, 1):
        judged[arrival] = intake.quarantine_arrival(rows.where(part == arrival), "PlayerID", index, arrival)
    both = [kept.select(F.lit(None).cast("string").alias(quality.REASON), *kept.columns).unionByName(rejects)
            for kept, rejects in judged.values()]
    return reduce(DataFrame.unionByName, both)


def q_top_values(spark, sf_dir):
    """A19, G10 by summaries: many distinct values (keys, money) beside few (flags); a third of the
    orders of lines have one part."""
    d = fx.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, 7).otherwise(F.col("l_partkey")).alias("part"),
        F.col("l_orderkey").alias("order"), "l_returnflag", "l_quantity", "l_extendedprice")
    return _long(heavy_hitters.top_values(d, d.columns), "rank")


def q_csv_split(spark, sf_dir):
    """Quoted line breaks in files that are read by many tasks each."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(fx.awkward(spark, sf_dir), path)
    small = spark.newSession()      # small splits, for this query only
    small.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    small.conf.set("spark.sql.files.openCostInBytes", "1024")
    return read_split_csv(small, path).drop(ROW_ORDER)


def q_dates_by_column(spark, sf_dir):
    """The same days written in two orders; each column's first date tells its own."""
    d = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("eu"), F.dayofmonth("o_orderdate").alias("d"))
    order = F.struct(F.col("d") <= 12, F.col("o_orderkey"))     # a day beyond 12 comes first
    turned = day_first_columns(d, ["us", "eu"], order)
    return d.select("o_orderkey", *[F.date_format(parse_date(c, day_first=turned[c]), "yyyy-MM-dd").alias(c)
                                    for c in ("us", "eu")])


def q_prior_csv(spark, sf_dir):
    """S3: a prior period read back from CSV, as it is joined."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(fx.prior(spark, sf_dir).drop(ROW_ORDER), path)
    seg, _ = segment.segment_players(_stored(fx.current(spark, sf_dir)))
    t = trend.apply_trend(seg, read_records(spark, path), "PlayerID")
    return t.select("PlayerID", "NetADT_Prev", "TrendPct", "Trend")


def q_worklist_file(spark, sf_dir):
    """The host worklist as published and read back."""
    return _published(spark, sf_dir, "worklist").select("Player", "Segment", "NetADT", F.col("rank").cast("bigint").alias("rank"))


def q_sql_file(spark, sf_dir):
    """The SQL result as published and read back."""
    back = _published(spark, sf_dir, "sql")
    return back.select("Segment", F.col("records").cast("bigint").alias("records"),
                       F.col("total_value").cast("double").alias("total_value"))


def _published(spark, sf_dir, name: str) -> DataFrame:
    out = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    res = runner.run_players(fx.players(spark, sf_dir), prev=fx.prior(spark, sf_dir))
    try:
        sql = run_sql(spark, res.segmented, default_query("NetADT"))
        publish_run(res, out, sql_result=sql)
    finally:
        res.release()
    return read_records(spark, published(spark, out)[name])


# -- stored layouts and summaries ----------------------------------------------

BUCKETS = 8     # on a cluster: rows / some millions, the same for all periods


def q_trend_stored(spark, sf_dir):
    """J1, J2 of two periods that are stored bucketed by id: the join exchanges nothing."""
    name = uuid.uuid4().hex
    folder = f"{ensure_checkpoint_dir(spark)}/periods-{name}"
    seg, _ = segment.segment_players(_stored(fx.current(spark, sf_dir)))
    cur = trend.store_current(seg, "PlayerID", f"current_{name}", BUCKETS, f"{folder}/current")
    prior = trend.store_prior(fx.prior(spark, sf_dir), "PlayerID", f"prior_{name}", BUCKETS, f"{folder}/prior")
    return trend.apply_trend_stored(cur, prior).select("PlayerID", "NetADT", "Segment", "NetADT_Prev", "TrendPct", "Trend")


def q_record_lookup_stored(spark, sf_dir):
    """F5 on records sorted by id: only the file and pages that can hold the id are read."""
    seg, _ = players_segmented(spark, sf_dir)
    stored = ex.StoredRecords.write(seg, "PlayerID", f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}", BUCKETS)
    return stored.by_id(spark, "P1").select("PlayerID", "FullName", "Segment")


def q_lookup_by_name_stored(spark, sf_dir):
    """F7 on records with their names sorted beside them; names repeat."""
    d = fx.players(spark, sf_dir).withColumn("FullName", F.concat(
        F.lit("Name "), (F.col(ROW_ORDER) % 10).cast("string")))
    stored = ex.StoredRecords.write(d, "PlayerID", f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}", BUCKETS)
    return stored.by_name(spark, "Name 3").select("PlayerID", "FullName")


def q_line_quantiles_summarised(spark, sf_dir):
    """G1, A16 from summaries kept per month of shipping: the exact cuts with one pass over the values."""
    lines = fx.lines(spark, sf_dir).withColumn("part", F.floor(F.col("days_since_ship") / 30))
    path = f"{ensure_checkpoint_dir(spark)}/summaries-{uuid.uuid4().hex}"
    summaries.summarise(lines, ["part"], ["amount", "days_since_ship"]).write.parquet(path)
    q = summaries.quantiles_from(lines, {"cut": ("amount", 0.75), "low": ("amount", 0.25),
                                         "median_days": ("days_since_ship", 0.5)}, spark.read.parquet(path))
    return lines.agg(F.count(F.lit(1)).alias("records"),
                     *[F.lit(v).cast("double").alias(k) for k, v in q.items()])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
