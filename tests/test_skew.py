"""A key or value holding a third of all rows: results stay whole and exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiercraft.operators import quality, rollup, skew
from tiercraft.operators.quantiles import quantiles


def _skewed(spark, n=3000):
    rows = [("HOT" if i % 3 == 0 else f"ID{i}", float(i % 7), i) for i in range(n)]
    return spark.createDataFrame(rows, "PlayerID string, NetADT double, _row_order long")


def test_hot_id_broadcast_shuffle_and_salted_paths_agree(spark, monkeypatch):
    df = _skewed(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # the planner's broadcast, a forced shuffle join, the hot id salted
        for threshold, hot_from in ((old, 10**6), ("-1", 10**6), ("-1", 10)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            monkeypatch.setattr(skew.join_hot, "__defaults__", (hot_from, "inner"))
            c = quality.classify_identity(df, "PlayerID")
            got = {r[0]: r[1] for r in c.groupBy("QuarantineReason").count().collect()}
            assert got == {None: 2001, "Duplicate PlayerID (first occurrence kept)": 999}
            first = c.where(F.col("PlayerID") == "HOT").where(
                F.col("QuarantineReason").isNull()).collect()
            assert [r["_row_order"] for r in first] == [0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tied_row_order_of_one_id_fails(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "PlayerID string, _row_order long")
    with pytest.raises(Exception, match="not unique"):
        quality.classify_identity(df, "PlayerID").collect()
    with pytest.raises(ValueError, match="_row_order"):
        quality.classify_identity(df.drop("_row_order"), "PlayerID")


def test_hot_segment_rollups_whole(spark):
    df = _skewed(spark).withColumn("Segment", F.when(F.col("_row_order") % 3 == 0, "Big")
                                   .otherwise(F.concat(F.lit("S"), (F.col("_row_order") % 5)
                                                       .cast("string"))))
    vt = rollup.value_table(df, "PlayerID", "NetADT").collect()
    assert sum(r.Records for r in vt) == 3000
    q = quantiles(df, "NetADT", {"m": 0.5, "q": 0.75})
    arr = np.array([float(i % 7) for i in range(3000)])
    assert q == {"m": float(np.quantile(arr, 0.5)), "q": float(np.quantile(arr, 0.75))}
