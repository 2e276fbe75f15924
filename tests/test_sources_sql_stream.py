"""CSV source, sinks, SQL over results, and the streaming runner."""

import os

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tiercraft.operators import quality, segment
from tiercraft.plans import runner
from tiercraft.plans.report import summary_report
from tiercraft.plans.sql import default_query, run_sql
from tiercraft.sources import read_records, roster, write_csv, write_lines, write_template
from tiercraft.sources.readers import ROW_ORDER
from tiercraft.streaming import segment_stream

CSV = """PlayerID,FullName,NetADT,DaysSinceLastVisit,CanEmail,ZipCode
P1,Ann,"$1,200.50",10,yes,11111
P2,Bob,NA,200,No,
 P1 ,Ann again,5,3,YES,22222
,Nobody,7,3,no,33333
P3,Cy,n/a,40,,44444
P4,Di,300,181,y,N/A
"""


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_csv_reader_tokens_and_order(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "players.csv")
    _write(p, CSV)
    df = read_records(spark, p)
    rows = df.orderBy(ROW_ORDER).collect()
    assert [r.PlayerID for r in rows] == ["P1", "P2", " P1 ", None, "P3", "P4"]
    assert rows[1].NetADT is None and rows[4].NetADT is None    # NA, n/a tokens
    assert rows[5].ZipCode is None                               # N/A token
    assert rows[0].NetADT == "$1,200.50"                         # text kept for parsing
    kept, rejects = quality.quarantine(df, "PlayerID")
    assert sorted(r.QuarantineReason for r in rejects.collect()) == [
        "Duplicate PlayerID (first occurrence kept)", "Missing PlayerID"]
    assert kept.where(F.col("PlayerID") == "P1").first().FullName == "Ann"


def test_run_players_from_csv_and_sinks(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "players.csv")
    _write(p, CSV)
    res = runner.run_players(read_records(spark, p))
    assert [s["Stage"] for s in res.run_log] == ["Quarantine", "Clean", "Segment",
                                                 "Aggregate"]
    assert res.run_log[0]["Rows in"] == 6 and res.run_log[0]["Rows out"] == 4
    seg = res.segmented
    assert dict(seg.select("PlayerID", "NetADT").collect())["P1"] == 1200.5
    out = os.path.join(tmpdir_path, "out")
    write_csv(seg, out + "/segmented")
    write_csv(res.rejects, out + "/rejects", single_file=True)
    write_template(seg, out + "/template")
    write_lines(summary_report("Player Segmentation Agent", res.health, res.value_table()),
                out + "/report")
    back = spark.read.option("header", "true").csv(out + "/segmented")
    assert back.count() == 4 and "Segment" in back.columns
    assert spark.read.option("header", "true").csv(out + "/template").count() == 0
    assert spark.read.option("header", "true").csv(out + "/template").columns[0] == "PlayerID"
    text = [r.value for r in spark.read.text(out + "/report").collect()]
    assert text[0] == "PLAYER SEGMENTATION AGENT" and text[1] == "=" * 25
    assert roster(seg, "PlayerID", "NetADT").columns == [
        "PlayerID", "FullName", "Segment", "NetADT", "DaysSinceLastVisit"]
    res.release()


def test_sql_box(spark):
    df = spark.createDataFrame([("a", 1.25, "X"), ("b", 2.5, "X"), ("c", 4.0, "Y")],
                               "PlayerID string, NetADT double, Segment string")
    rows = {r.Segment: (r.records, r.total_value)
            for r in run_sql(spark, df, default_query("NetADT")).collect()}
    assert rows == {"X": (2, 3.75), "Y": (1, 4.0)}
    try:
        run_sql(spark, df, "SELECT nope FROM records")
    except ValueError as e:
        assert str(e).startswith("Query failed:")
    else:
        raise AssertionError("bad SQL should fail")


def test_stream_segments_each_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    _write(os.path.join(src, "a.csv"), CSV)
    schema = StructType([StructField(c, StringType()) for c in
                         ["PlayerID", "FullName", "NetADT", "DaysSinceLastVisit", "CanEmail",
                          "ZipCode"]])
    sink = os.path.join(tmpdir_path, "sink")
    q = segment_stream(spark, src, schema, sink, checkpoint=os.path.join(tmpdir_path, "ck"),
                       available_now=True)
    q.awaitTermination(300)
    seg = spark.read.parquet(sink + "/segmented")
    assert seg.count() == 4
    assert spark.read.parquet(sink + "/rejects").count() == 2
    assert spark.read.parquet(sink + "/value_table").select("batch_id").distinct().count() == 1


def test_segment_players_on_csv_text_values(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "p.csv")
    _write(p, "PlayerID,NetADT,DaysSinceLastVisit\nA,$10,1\nB,$20,300\nC,$30,5\nD,$40,5\n")
    seg, cut = segment.segment_players(read_records(spark, p))
    assert cut == 32.5
    got = {r.PlayerID: r.Segment for r in seg.collect()}
    assert got == {"A": "Active Developing", "B": "Churned Low Value", "C": "Active Developing",
                   "D": "VIP High Value"}


def test_runner_checkpoint_mode_and_shuffle_fallback(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "players.csv")
    _write(p, CSV)
    a = runner.run_players(read_records(spark, p))
    b = runner.run_players(read_records(spark, p), keep="checkpoint")
    key = ["PlayerID", "NetADT", "Segment"]
    assert sorted(map(tuple, a.segmented.select(key).collect())) == \
        sorted(map(tuple, b.segmented.select(key).collect()))
    lazy = quality.classify_identity(read_records(spark, p), "PlayerID")
    assert sorted(r.QuarantineReason or "" for r in lazy.collect()) == sorted(
        r.QuarantineReason or "" for r in a.classified.collect())
    a.release()
    b.release()


def test_export_run(spark, tmpdir_path):
    from tiercraft.plans.export import export_run
    p = os.path.join(tmpdir_path, "players.csv")
    _write(p, CSV)
    res = runner.run_players(read_records(spark, p))
    paths = export_run(res, os.path.join(tmpdir_path, "export"),
                       sql_result=run_sql(spark, res.segmented, default_query("NetADT")))
    assert set(paths) == {"segmented", "rejects", "value_table", "summary", "roster",
                          "worklist", "sql"}
    read = lambda k: spark.read.option("header", "true").csv(paths[k])
    assert read("segmented").count() == 4 and read("rejects").count() == 2
    assert read("roster").columns[0] == "PlayerID"
    assert spark.read.text(paths["summary"]).count() > 5
    res.release()


def test_value_table_text_matches_pandas(spark):
    import numpy as np
    import pandas as pd

    from tiercraft.plans.report import value_table_lines
    cases = [
        [("At Risk High Value", 176, 61234.56, 347.92), ("Casual", 3, 7.5, 2.5)],
        [("A", 1, 1.0, None), ("Bb", 2, 2.0, 2.5)],
        [("A", 1, -1.25, 10000000.5), ("Bb", 2, 2.0, 2.5)],
        [("LongSegmentNameHere", 10, 123456789.12, 1.1)],
        [("x", 1234567, 0.0000001, 3.0), ("y", 5, 2.0, 4.25)],
    ]
    for rows in cases:
        vt = spark.createDataFrame(
            [(s, r, t, a, i + 1) for i, (s, r, t, a) in enumerate(rows)],
            "Segment string, Records long, TotalValue double, AvgValue double, rank int")
        got = "\n".join(r.line for r in value_table_lines(vt).orderBy("line_no").collect())
        pdf = pd.DataFrame({"Records": [r for _, r, _, _ in rows],
                            "TotalValue": [t for _, _, t, _ in rows],
                            "AvgValue": [np.nan if a is None else a for _, _, _, a in rows]},
                           index=pd.Index([s for s, _, _, _ in rows], name="Segment"))
        assert got == pdf.to_string()


def test_stream_two_batches_and_restart(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in2")
    os.makedirs(src)
    _write(os.path.join(src, "a.csv"), CSV)
    _write(os.path.join(src, "b.csv"),
           "PlayerID,FullName,NetADT,DaysSinceLastVisit,CanEmail,ZipCode\n"
           "Q1,Al,10,5,yes,1\nQ2,Bo,20,300,no,2\nQ2,Bo again,30,3,no,3\n")
    schema = StructType([StructField(c, StringType()) for c in
                         ["PlayerID", "FullName", "NetADT", "DaysSinceLastVisit", "CanEmail",
                          "ZipCode"]])
    sink = os.path.join(tmpdir_path, "sink2")
    ck = os.path.join(tmpdir_path, "ck2")
    for _ in range(2):       # second start resumes from the checkpoint: nothing new
        q = segment_stream(spark, src, schema, sink, checkpoint=ck, available_now=True,
                           max_files_per_trigger=1)
        q.awaitTermination(300)
        seg = spark.read.parquet(sink + "/segmented")
        assert seg.count() == 4 + 2
        assert seg.select("batch_id").distinct().count() == 2
    rej = spark.read.parquet(sink + "/rejects")
    assert rej.count() == 2 + 1


def test_empty_input_runs_through(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "empty.csv")
    _write(p, "PlayerID,FullName,NetADT,DaysSinceLastVisit,CanEmail,ZipCode\n")
    res = runner.run_players(read_records(spark, p))
    assert res.segmented.count() == 0 and res.rejects.count() == 0
    assert res.value_table().count() == 0
    assert res.value_bands().count() == 0
    assert res.distribution_insight().first().insight == "No numeric values to analyze."
    assert [r.line for r in res.health.orderBy("line_no").collect()][:2] == [
        "0 records loaded across 6 columns.", "0.0% of all cells are empty."]
    res.release()


NASTY = [("P1", 'Ann "Ace" Lee, Jr', "5"), (" P2 ", "two\nlines", "1,000"), ("P3", "NA", "$7"),
         ("P4", 'say "hi"', " 8 "), ("P5", "", None), ("P6", "back\\slash\\", "n/a")]


def test_csv_round_trip_matches_duckdb_and_pandas(spark, tmpdir_path):
    import glob

    import duckdb
    import pandas as pd

    from tiercraft.sources.sinks import write_csv
    df = spark.createDataFrame(NASTY, "`Member No.` string, FullName string, Net string")
    write_csv(df, tmpdir_path + "/out", single_file=True)
    (part,) = glob.glob(tmpdir_path + "/out/part-*.csv")
    back = [tuple(r)[:3] for r in read_records(spark, part).collect()]
    null = {"NA", "", "n/a", None}
    want = [tuple(None if v in null else v for v in r) for r in NASTY]
    assert sorted(back) == sorted(want)
    pdf = pd.read_csv(part, dtype=str)
    assert sorted(tuple(None if pd.isna(v) else v for v in r)
                  for r in pdf.itertuples(index=False)) == sorted(want)
    rows = duckdb.sql(f"SELECT * FROM read_csv('{part}', all_varchar=true, header=true, quote='\"', "
                      "escape='\"', delim=',')").fetchall()
    assert sorted(tuple(None if v in null else v for v in r) for r in rows) == sorted(want)


def test_csv_quoted_cell_as_pandas_reads_it(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "q.csv")
    _write(p, 'PlayerID,FullName,NetADT\nP1,"Ann ""Ace"" Lee, Jr",5\nP2,"a\nb",6\n')
    rows = [tuple(r)[:3] for r in read_records(spark, p).orderBy("PlayerID").collect()]
    assert rows == [("P1", 'Ann "Ace" Lee, Jr', "5"), ("P2", "a\nb", "6")]


def test_swapped_header_fails_instead_of_shifting(spark, tmpdir_path):
    import pytest
    src = os.path.join(tmpdir_path, "swap")
    os.makedirs(src)
    _write(os.path.join(src, "a.csv"), "PlayerID,NetADT\nA,1\n")
    _write(os.path.join(src, "b.csv"), "NetADT,PlayerID\n2,B\n")
    with pytest.raises(Exception):
        read_records(spark, src).collect()
    schema = StructType([StructField(c, StringType()) for c in ("PlayerID", "NetADT")])
    q = segment_stream(spark, src, schema, tmpdir_path + "/sink3", tmpdir_path + "/ck3", available_now=True)
    with pytest.raises(Exception):
        q.awaitTermination(300)
    with pytest.raises(ValueError):
        segment_stream(spark, src, schema, tmpdir_path + "/sink3", "", available_now=True)


def test_two_streams_of_a_mode_and_a_restart_keep_earlier_batches(spark, tmpdir_path):
    head = "PlayerID,FullName,NetADT,DaysSinceLastVisit,CanEmail,ZipCode\n"
    schema = StructType([StructField(c, StringType()) for c in head.strip().split(",")])

    def run(k):
        segment_stream(spark, f"{tmpdir_path}/in{k}", schema, f"{tmpdir_path}/sink{k}",
                       f"{tmpdir_path}/ck{k}", available_now=True).awaitTermination(300)
    for k in "ab":
        os.makedirs(f"{tmpdir_path}/in{k}")
        _write(f"{tmpdir_path}/in{k}/1.csv", head + f"{k}1,Al,10,5,yes,1\n")
        run(k)
    os.rename(f"{tmpdir_path}/ina/1.csv", f"{tmpdir_path}/archived.csv")
    _write(f"{tmpdir_path}/ina/2.csv", head + "a2,Bo,10,5,yes,1\n")
    run("a")
    ids = lambda k: sorted(r.PlayerID for r in spark.read.parquet(f"{tmpdir_path}/sink{k}/segmented").collect())
    assert ids("a") == ["a1", "a2"] and ids("b") == ["b1"]


def test_sql_errors_of_running_surface(spark):
    import pytest
    df = spark.createDataFrame([("a", 1.0, "X")], "PlayerID string, NetADT double, Segment string")
    with pytest.raises(ValueError, match="^Query failed"):
        run_sql(spark, df, "SELECT CAST(PlayerID AS INT) FROM records")
