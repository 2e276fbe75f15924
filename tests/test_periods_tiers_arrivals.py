"""As-of join, band join, arrivals, frequent values, date order, publishing: against plain Python."""

import bisect
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tiercraft.functions.dates import day_first_columns, parse_date
from tiercraft.operators import asof, bands, heavy_hitters, intake, quality
from tiercraft.plans import export, runner
from tiercraft.sources import read_records
from tiercraft.sources.readers import ROW_ORDER
from tiercraft.streaming import segment_stream


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_asof_with_a_hot_key(spark, partitions):
    rng = random.Random(partitions)
    key = lambda: "hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}"
    cur = [(i, None if i % 50 == 0 else key(), None if i % 41 == 0 else rng.randrange(1000)) for i in range(1200)]
    prior = list({(key(), rng.randrange(1000)): None for _ in range(600)}) + [(None, 5), ("hot", None)]
    prior = [(k, t, float(i)) for i, (k, t) in enumerate(prior)]
    c = spark.createDataFrame(cur, "n long, id string, at long").repartition(7)
    p = spark.createDataFrame(prior, "pid string, t long, v double").repartition(3)
    got = {r.n: (r.v, r.t) for r in asof.asof_join(c, p, "id", "at", "pid", "t", {"v": "v", "t": "t"}, partitions).collect()}
    by = {}
    for k, t, v in sorted((k, t, v) for k, t, v in prior if k is not None and t is not None):
        by.setdefault(k, []).append((t, v))
    for n, k, at in cur:
        i = bisect.bisect_right(by.get(k, []), (at, float("inf"))) if at is not None else 0
        want = by[k][i - 1] if i else (None, None)
        assert got[n] == (want[1], want[0]), (n, k, at)
    assert len(got) == len(cur)


def test_asof_of_nothing(spark):
    c = spark.createDataFrame([(1, "a", 5)], "n long, id string, at long")
    p = spark.createDataFrame([], "id string, t long, v double")
    assert asof.asof_join(c, p, "id", "at", "id", "t", {"v": "v"}).first().v is None
    assert asof.asof_join(c.limit(0), p, "id", "at", "id", "t", {"v": "v"}).count() == 0


def test_asof_ties_take_the_last_row(spark):
    c = spark.createDataFrame([("a", 5)], "id string, at long")
    p = spark.createDataFrame([("a", 5, 1.0, 10), ("a", 5, 2.0, 9), ("a", 6, 3.0, 11)], f"id string, t long, v double, {ROW_ORDER} long")
    assert asof.asof_join(c, p, "id", "at", "id", "t", {"v": "v"}).first().v == 1.0


def test_bins_never_fall(spark):
    vals = sorted([0.0, -0.0, 1e-300, 0.5, 1, 1.5, 2, 3, 1e6, 1e300, -1e300, -7, -0.1] + [random.uniform(-1e5, 1e5) for _ in range(500)])
    got = [r.b for r in spark.createDataFrame([(float(v), i) for i, v in enumerate(vals)], "v double, i int")
           .orderBy("i").select(bands.value_bin(F.col("v")).alias("b")).collect()]
    assert got == sorted(got) and min(got) >= -bands.BINS and max(got) <= bands.BINS


def test_band_join_by_brute_force(spark):
    rng = random.Random(2)
    tiers = [(f"p{rng.randrange(4)}", rng.choice([None, rng.uniform(-500, 900)]), rng.choice([None, rng.uniform(-300, 2000)]), f"t{i}")
             for i in range(60)]
    rows = [(i, "p0" if i % 3 else rng.choice(["p1", "p2", "none", None]), rng.choice([None, rng.uniform(-800, 2500), 0.0]))
            for i in range(900)]
    for lo in (t[1] for t in tiers if t[1] is not None):
        rows.append((len(rows), "p1", lo))          # values on a border
    r = spark.createDataFrame(rows, "i long, prop string, v double").repartition(4)
    t = spark.createDataFrame(tiers, "property string, low double, high double, offer string")
    joined = bands.band_join(r, t, F.col("v"), {"prop": "property"}, hot_from=100)
    got = Counter((x.i, x.offer) for x in joined.collect())
    want = Counter()
    for i, p, v in rows:
        hits = [o for q, lo, hi, o in tiers if q == p and v is not None and (lo is None or v >= lo) and (hi is None or v < hi)]
        want.update((i, o) for o in hits or [None])
    assert got == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert bands.band_join(r, t.limit(0), F.col("v"), {"prop": "property"}).where("offer IS NULL").count() == len(rows)
    with pytest.raises(ValueError):
        bands.band_join(r.withColumn("low", F.lit(1)), t, F.col("v"), {"prop": "property"})


@pytest.mark.parametrize("k", [1, 4])
def test_arrivals_keep_what_one_run_keeps(spark, tmpdir_path, k):
    rng = random.Random(k)
    ids = [rng.choice([f" a{rng.randrange(60)}", f"a{rng.randrange(60)} ", None, "nan", "b"]) for _ in range(400)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], f"id string, {ROW_ORDER} long")
    once = {(r[ROW_ORDER], r[quality.REASON]) for r in quality.classify_identity(rows, "id").collect()}
    index, got = os.path.join(tmpdir_path, "ids"), {}
    cuts = [400 * i // k for i in range(k + 1)]
    for n in [*range(k), *range(k - 1, -1, -1)]:        # all arrivals, then all replayed, last first
        part = rows.where(F.col(ROW_ORDER).between(cuts[n], cuts[n + 1] - 1))
        kept, rejects = intake.quarantine_arrival(part, "id", index, n)
        got[n] = {(r[ROW_ORDER], None) for r in kept.collect()} | {(r[ROW_ORDER], r[quality.REASON]) for r in rejects.collect()}
    assert set().union(*got.values()) == once
    index_rows = intake.accepted_ids(spark, index).collect()
    assert len(index_rows) == sum(reason is None for _, reason in once) == len({r.id for r in index_rows})
    with pytest.raises(ValueError):
        intake.quarantine_arrival(rows, "id", index, -1)


def test_stream_knows_ids_of_earlier_batches(spark, tmpdir_path):
    names = ["PlayerID", "NetADT", "DaysSinceLastVisit"]
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for n, text in enumerate(["A,10,1\nB,20,300\n", "B,99,5\nC,40,5\n,1,1\n"]):
        with open(f"{src}/{n}.csv", "w") as f:
            f.write(",".join(names) + "\n" + text)
        os.utime(f"{src}/{n}.csv", (1000 + n, 1000 + n))
    sink = os.path.join(tmpdir_path, "out")
    q = segment_stream(spark, src, StructType([StructField(c, StringType()) for c in names]), sink,
                       os.path.join(tmpdir_path, "ck"), available_now=True, max_files_per_trigger=1,
                       id_index=os.path.join(tmpdir_path, "ids"))
    q.awaitTermination(300)
    assert sorted(r.PlayerID for r in spark.read.parquet(f"{sink}/segmented").collect()) == ["A", "B", "C"]
    assert sorted(r.QuarantineReason for r in spark.read.parquet(f"{sink}/rejects").collect()) == [
        "Duplicate PlayerID (first occurrence kept)", "Missing PlayerID"]


def test_frequent_values(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 == 0 else f"v{i}", f"u{i}", rng.choice("abc"), None if i % 2 else str(i % 5)) for i in range(6000)]
    df = spark.createDataFrame(rows, "mixed string, unique string, few string, nulls string").repartition(6)
    proven, rest = heavy_hitters.candidates(df, df.columns, 1, slots=64)
    assert "hot" in proven["mixed"] and set(rest) == {"unique"} and len(proven["few"]) <= 3
    for k in (1, 3):
        got = {(r.column, r["rank"]): (r.value, r["count"]) for r in heavy_hitters.top_values(df, df.columns, k, slots=64).collect()}
        want = {}
        for j, c in enumerate(df.columns):
            counted = Counter(r[j] for r in rows if r[j] is not None)
            for n, (v, m) in enumerate(sorted(counted.items(), key=lambda x: (-x[1], x[0]))[:k]):
                want[c, n + 1] = (v, m)
        assert got == want
    assert heavy_hitters.top_values(df.limit(0), df.columns).count() == 0


def test_first_date_decides_the_order(spark):
    rows = [(2, "03/04/2026", "25/04/2026", "2026-04-03", None), (1, "03/04/2026", "03/04/2026", "04/03/2026", None),
            (0, None, "31/12/2025 7:05", "x", None)]
    df = spark.createDataFrame(rows, "o long, us string, eu string, iso string, none string")
    turned = day_first_columns(df, ["us", "eu", "iso", "none"], "o")
    assert turned == {"us": False, "eu": True, "iso": False, "none": False}
    got = df.orderBy("o").select(*[F.date_format(parse_date(c, day_first=turned[c]), "yyyy-MM-dd").alias(c) for c in ("us", "eu")]).collect()
    assert [tuple(r) for r in got] == [(None, "2025-12-31"), ("2026-03-04", "2026-04-03"), ("2026-03-04", "2026-04-25")]
    assert day_first_columns(df, [], "o") == {}


def test_publishing_survives_a_failed_job(spark, tmpdir_path):
    text = "PlayerID,FullName,NetADT,DaysSinceLastVisit,CanEmail,ZipCode\nP1,Ann,10,1,y,1\nP2,Bob,20,200,n,2\n"
    path, out = os.path.join(tmpdir_path, "p.csv"), os.path.join(tmpdir_path, "out")
    with open(path, "w") as f:
        f.write(text)
    assert export.published(spark, out) == {}
    res = runner.run_players(read_records(spark, path))
    first = export.publish_run(res, out, run_id="a")
    assert export.published(spark, out) == first
    broken = spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    with pytest.raises(Exception, match="lost"):
        export.publish_run(res, out, run_id="b", sql_result=broken)
    assert export.published(spark, out) == first
    assert spark.read.option("header", "true").csv(first["segmented"]).count() == 2
    again = export.publish_run(res, out, run_id="b")
    assert export.published(spark, out) == again != first
    assert spark.read.option("header", "true").csv(first["segmented"]).count() == 2     # readers of the old version go on
    res.release()
