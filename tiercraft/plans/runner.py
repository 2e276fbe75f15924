"""Mode runners: the whole segmentation run as Spark jobs, with a run log.

Each stage is materialised once (``persist`` + ``count``), which is both the
rows-out figure of the run log and the reuse point for every later rollup,
so the input is scanned and quarantined once however many reports follow.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercraft.config import CLEAN_CUSTOM, COMPANIES, MEANINGS_BY_MODE, PLAYERS, ModeConfig
from tiercraft.functions.columns import col, sentence
from tiercraft.operators import quality, rollup, segment, trend
from tiercraft.session import ensure_checkpoint_dir

STORAGE = StorageLevel.MEMORY_AND_DISK


def materialize(df: DataFrame, how: str = "persist") -> DataFrame:
    """Keep a stage for reuse. ``persist``: executor memory/disk, rebuilt from
    lineage if an executor is lost. ``checkpoint``: written to the shared
    ``spark.checkpoint.dir``, lineage cut (for very long or costly inputs).
    The persisted form is lazy (the stage's count fills it); the checkpoint
    is written at once, computed a single time through a transient cache."""
    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        cached = df.persist(STORAGE)
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    if how == "persist":
        return df.persist(STORAGE)
    raise ValueError(f"unknown materialisation {how!r}")


@dataclass
class RunResult:
    cfg: ModeConfig
    classified: DataFrame
    kept: DataFrame
    rejects: DataFrame
    segmented: DataFrame
    cut: float | None
    clean_report: DataFrame
    missing_rate: float
    health: DataFrame
    meanings: dict
    value_summary: DataFrame             # the value table, from the Aggregate stage
    run_log: list[dict] = field(default_factory=list)
    pareto: DataFrame | None = None
    value_stats: tuple | None = None     # (count, min, max) of the segmented value

    def value_bands(self, sym: str = "$") -> DataFrame:
        return rollup.value_bands(self.segmented, self.cfg.value_col, sym,
                                  stats=self.value_stats)

    def distribution_insight(self, sym: str = "$") -> DataFrame:
        return rollup.distribution_insight(self.segmented, self.cfg.value_col, sym,
                                           stats=self.value_stats)

    def log_frame(self) -> DataFrame:
        spark = self.segmented.sparkSession
        rows = [(r["Stage"], str(r["Rows in"]), str(r["Rows out"]), float(r["Seconds"]))
                for r in self.run_log]
        return spark.createDataFrame(rows, "Stage string, `Rows in` string, "
                                           "`Rows out` string, Seconds double")

    def counts(self) -> DataFrame:
        return rollup.segment_counts(self.segmented, self.meanings)

    def value_table(self) -> DataFrame:
        return self.value_summary

    def release(self) -> None:
        """Free the run's cached stages."""
        for d in (self.classified, self.segmented, self.value_summary):
            d.unpersist()


def _count_with_stats(frame: DataFrame, value_col: str | None) -> tuple[int, tuple | None]:
    """Row count plus the value column's (count, min, max), one pass."""
    if not value_col or value_col not in frame.columns:
        return frame.count(), None
    v = col(value_col)
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("vn"),
                    F.min(v).alias("vmin"), F.max(v).alias("vmax")).first()
    return row["n"], (row["vn"], row["vmin"], row["vmax"])


class _Stages:
    def __init__(self, keep: str = "persist"):
        self.log: list[dict] = []
        self.keep = keep

    def run(self, name: str, rows_in: int, frame: DataFrame, value_col: str | None = None
            ) -> tuple[DataFrame, int, tuple | None]:
        """Materialise a stage; its row count (and, when asked, the value
        column's count / min / max for the next quantile) come from the same
        pass."""
        t0 = time.perf_counter()
        frame = materialize(frame, self.keep)
        aggs = [F.count(F.lit(1)).alias("n")]
        if value_col:
            v = col(value_col)
            aggs += [F.count(v).alias("vn"), F.min(v).alias("vmin"), F.max(v).alias("vmax")]
        row = frame.agg(*aggs).first()
        n = row["n"]
        stats = (row["vn"], row["vmin"], row["vmax"]) if value_col else None
        self.log.append({"Stage": name, "Rows in": rows_in, "Rows out": n,
                         "Seconds": round(time.perf_counter() - t0, 3)})
        return frame, n, stats


def _aggregate(seg: DataFrame, cfg: ModeConfig, rows: int, stages: _Stages) -> DataFrame:
    """The value table (a row per segment), materialised as the last stage."""
    t0 = time.perf_counter()
    table = rollup.value_table(seg, cfg.id_col, cfg.value_col).persist(STORAGE)
    table.count()
    stages.log.append({"Stage": "Aggregate", "Rows in": rows, "Rows out": rows,
                       "Seconds": round(time.perf_counter() - t0, 3)})
    return table


def _quarantine(df: DataFrame, cfg: ModeConfig, stages: _Stages):
    t0 = time.perf_counter()
    classified = materialize(quality.classify_identity(df, cfg.id_col), stages.keep)
    split = classified.agg(F.count(F.lit(1)).alias("n"),
                           F.count_if(F.col(quality.REASON).isNull()).alias("kept")).first()
    rows_in, kept_n = split["n"], split["kept"]
    stages.log.append({"Stage": "Quarantine", "Rows in": rows_in, "Rows out": kept_n,
                       "Seconds": round(time.perf_counter() - t0, 3)})
    kept = classified.where(F.col(quality.REASON).isNull()).drop(quality.REASON)
    rejects = classified.where(F.col(quality.REASON).isNotNull())
    return classified, kept, rejects, kept_n


def run_players(df: DataFrame, prev: DataFrame | None = None, cfg: ModeConfig = PLAYERS,
                as_of: datetime | str | None = None, method: str = "exact",
                keep: str = "persist") -> RunResult:
    stages = _Stages(keep)
    classified, kept, rejects, kept_n = _quarantine(df, cfg, stages)
    cleaned = quality.clean(kept, cfg.value_col, cfg.consent_cols, cfg.flag_col, method)
    cleaned_df, n_clean, vstats = stages.run("Clean", kept_n, cleaned.cleaned, cfg.value_col)
    t0 = time.perf_counter()
    seg, cut = segment.segment_players(cleaned_df, as_of=as_of, method=method,
                                       value_stats=vstats)
    if prev is not None:
        seg = trend.apply_trend(seg, prev, cfg.id_col)
    seg = materialize(seg, stages.keep)
    n_seg, seg_stats = _count_with_stats(seg, cfg.value_col)
    stages.log.append({"Stage": "Segment + Trend" if prev is not None else "Segment",
                       "Rows in": n_clean, "Rows out": n_seg,
                       "Seconds": round(time.perf_counter() - t0, 3)})
    cleaned_df.unpersist()
    rate = cleaned.issue_rate if cleaned.issue_rate is not None else \
        cleaned.metrics.first()["issue_rate"]
    return RunResult(cfg, classified, kept, rejects, seg, cut, cleaned.report, rate,
                     quality.health(df, "players"), MEANINGS_BY_MODE["players"],
                     _aggregate(seg, cfg, n_seg, stages), stages.log, rollup.pareto(seg), seg_stats)


def run_companies(df: DataFrame, cfg: ModeConfig = COMPANIES, method: str = "exact",
                  keep: str = "persist") -> RunResult:
    stages = _Stages(keep)
    classified, kept, rejects, kept_n = _quarantine(df, cfg, stages)
    cleaned = quality.clean(kept, cfg.value_col, cfg.consent_cols, cfg.flag_col, method)
    cleaned_df, n_clean, vstats = stages.run("Clean", kept_n, cleaned.cleaned, cfg.value_col)
    t0 = time.perf_counter()
    seg, cut = segment.segment_companies(cleaned_df, method=method, value_stats=vstats)
    seg = materialize(seg, stages.keep)
    n_seg, seg_stats = _count_with_stats(seg, cfg.value_col)
    stages.log.append({"Stage": "Segment", "Rows in": n_clean, "Rows out": n_seg,
                       "Seconds": round(time.perf_counter() - t0, 3)})
    cleaned_df.unpersist()
    rate = cleaned.issue_rate if cleaned.issue_rate is not None else \
        cleaned.metrics.first()["issue_rate"]
    return RunResult(cfg, classified, kept, rejects, seg, cut, cleaned.report, rate,
                     quality.health(df, "companies"), MEANINGS_BY_MODE["companies"],
                     _aggregate(seg, cfg, n_seg, stages), stages.log, None, seg_stats)


def run_custom(df: DataFrame, id_col: str | None, value_col: str, recency_col: str | None,
               approach: str | None = None, as_of: datetime | str | None = None,
               method: str = "exact", keep: str = "persist") -> RunResult:
    """Custom mode: no cleaning step, so 'Needs Review' is reachable."""
    approach = approach or ("Value + Recency" if recency_col else "Value only")
    cfg = ModeConfig(mode="custom", title="Custom Segmentation Agent", id_col=id_col,
                     value_col=value_col, recency_col=recency_col, approach=approach)
    stages = _Stages(keep)
    classified, kept, rejects, kept_n = _quarantine(df, cfg, stages)
    t0 = time.perf_counter()
    seg, cut = segment.segment_custom(kept, value_col, recency_col, approach, as_of, method)
    seg = materialize(seg, stages.keep)
    n_seg, seg_stats = _count_with_stats(seg, cfg.value_col)
    stages.log.append({"Stage": "Clean + Segment", "Rows in": kept_n, "Rows out": n_seg,
                       "Seconds": round(time.perf_counter() - t0, 3)})
    report = kept.sparkSession.range(1).select(
        F.lit(1).alias("line_no"), sentence(CLEAN_CUSTOM, column=value_col).alias("line"))
    # share of kept rows whose value does not parse = 1 - parsed / kept
    rate = (kept_n - seg_stats[0]) / kept_n if kept_n and seg_stats else 0.0
    return RunResult(cfg, classified, kept, rejects, seg, cut, report, rate,
                     quality.health(df, "custom", value_col), MEANINGS_BY_MODE["custom"],
                     _aggregate(seg, cfg, n_seg, stages), stages.log, None, seg_stats)
