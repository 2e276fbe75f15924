"""CSV files split inside quoted cells, against the multi-line reader and Python's own."""

import csv
import random

import pytest

from tiercraft.sources.readers import ROW_ORDER, read_records
from tiercraft.sources.split_csv import read_split_csv

CELLS = ["plain", "", "a,b", 'say "hi"', "two\nlines", "\n\nstarts with blank lines", 'ends with quote"', '"', '""', " blanks ",
         "line\nwith \"quote\"\nand, comma", "é😀", "x" * 300, "many\n" * 40, ",", "\n", 'mid"dle', "NA"]


def small_splits(spark, size):
    s = spark.newSession()
    s.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    s.conf.set("spark.sql.files.openCostInBytes", "1")
    return s


def rows_of(df):
    return [tuple(r) for r in df.orderBy(ROW_ORDER).drop(ROW_ORDER).collect()]


@pytest.mark.parametrize("size, newline", [(37, "\n"), (200, "\r\n"), (2000, "\n"), (10 ** 8, "\n")])
def test_like_the_multi_line_reader(spark, tmpdir_path, size, newline):
    rng = random.Random(size)
    names = ["id", "name, with comma", "free text"]
    rows = [[f"k{i}", rng.choice(CELLS), rng.choice(CELLS)] for i in range(250)]
    for part in (0, 1):
        with open(f"{tmpdir_path}/{part}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=newline)
            out.writerow(names)
            out.writerows(rows[part * 125:part * 125 + 125])
    got = rows_of(read_split_csv(small_splits(spark, size), tmpdir_path))
    assert got == rows_of(read_records(spark, tmpdir_path))
    assert len(got) == 250 and got[7][0] == "k7"
    na = {"", "NA"}
    assert got == [tuple(None if c in na else c for c in r) for r in rows]


def test_many_tasks_read_one_file(spark, tmpdir_path):
    with open(f"{tmpdir_path}/one.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "text"])
        out.writerows([str(i), "first\nsecond, \"third\"\n" * (i % 4)] for i in range(2000))
    df = read_split_csv(small_splits(spark, 1000), tmpdir_path)
    assert df.rdd.getNumPartitions() > 10
    assert df.selectExpr("sum(cast(id as long))", "count(*)").first() == (1999000, 2000)


def test_awkward_files(spark, tmpdir_path):
    with open(f"{tmpdir_path}/a.csv", "w", newline="") as f:
        f.write('id,text,more\n1,un"quoted,x\n\n2,short\n3,"never closed,\n4,is part of it\n')
    got = rows_of(read_split_csv(small_splits(spark, 12), f"{tmpdir_path}/a.csv"))
    assert [r[0] for r in got] == ["1", "2", "3"]
    assert got[:2] == [("1", 'un"quoted', "x"), ("2", "short", None)]
    with open(f"{tmpdir_path}/b.csv", "w") as f:
        f.write("id,other\n")
    with pytest.raises(ValueError, match="common header"):
        read_split_csv(spark, tmpdir_path)
    only = rows_of(read_split_csv(spark, f"{tmpdir_path}/b.csv"))
    assert only == []
