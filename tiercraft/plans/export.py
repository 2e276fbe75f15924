"""Write the outputs of a run (the original's download buttons) as files.

Large outputs (segmented rows, rejects, worklist, roster) are written by all
tasks in parallel; bounded reports (summary text, value table, SQL result
when small) go to one file each.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercraft.operators import worklist
from tiercraft.plans.report import summary_report
from tiercraft.plans.runner import RunResult
from tiercraft.sources.sinks import roster, write_csv, write_lines


def export_run(result: RunResult, out_dir: str, sym: str = "$",
               sql_result: DataFrame | None = None) -> dict[str, str]:
    """Write segmented rows, rejects, value table, summary report, roster,
    the host worklist (players) and an optional SQL result under
    ``out_dir``; returns the paths written."""
    cfg = result.cfg
    out = out_dir.rstrip("/")
    paths = {
        "segmented": f"{out}/segmented_output",
        "rejects": f"{out}/quarantined_rows",
        "value_table": f"{out}/value_by_segment",
        "summary": f"{out}/segmentation_summary",
        "roster": f"{out}/roster",
    }
    write_csv(result.segmented, paths["segmented"])
    write_csv(result.rejects, paths["rejects"])
    vt = result.value_table()
    write_csv(vt.orderBy("rank"), paths["value_table"], single_file=True)
    write_lines(summary_report(cfg.title, result.health, vt), paths["summary"])
    write_csv(roster(result.segmented, cfg.id_col, cfg.value_col), paths["roster"])
    if cfg.mode == "players":
        paths["worklist"] = f"{out}/host_worklist"
        write_csv(worklist.host_worklist(result.segmented, sym, id_col=cfg.id_col or "PlayerID"),
                  paths["worklist"])
    if sql_result is not None:
        paths["sql"] = f"{out}/query_result"
        write_csv(sql_result, paths["sql"])
    return paths


_MANIFEST = "version long, at double, run_id string, paths map<string,string>"


def _manifests(spark: SparkSession, out_dir: str) -> DataFrame:
    folder = f"{out_dir.rstrip('/')}/manifests"
    spark.createDataFrame([], _MANIFEST).write.mode("ignore").json(folder)
    return spark.read.schema(_MANIFEST).json(folder)


def published(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """The paths of the current version's outputs; empty before the first one."""
    newest = _manifests(spark, out_dir).orderBy(F.desc("version"), F.desc("at"), F.desc("run_id")).first()
    return dict(newest["paths"]) if newest else {}


def publish_run(result: RunResult, out_dir: str, run_id: str | None = None, **options) -> dict[str, str]:
    """:func:`export_run` so that a failed job harms nothing that was published before.

    All outputs go to a folder of their own first. Only when they are whole, one
    line is added to the manifests; it names them all, so readers
    (:func:`published`) see one version of everything, the old one until then.
    A run that is published again adds the same outputs as a newer version; what a
    failed attempt left lies in a folder that no manifest names.
    """
    spark = result.segmented.sparkSession
    run_id = run_id or uuid.uuid4().hex
    out = out_dir.rstrip("/")
    paths = export_run(result, f"{out}/versions/{run_id}-{uuid.uuid4().hex[:8]}", **options)
    version = (_manifests(spark, out_dir).agg(F.max("version")).first()[0] or 0) + 1
    (spark.createDataFrame([(version, time.time(), run_id, paths)], _MANIFEST).coalesce(1)
     .write.mode("append").json(f"{out}/manifests"))
    return paths
