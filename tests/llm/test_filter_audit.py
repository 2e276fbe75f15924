"""Filter audit against running every order filter by filter."""

from collections import defaultdict
from itertools import permutations
from math import factorial

import duckdb
import pytest

from tiercraft.llm import filter_audit, oracle, queries

from conftest_llm import AWKWARD

SF = "/root/testdata/sf0.001"


def replay(rows, filters):
    """Every order by brute force over (part, mask, good, toxic) rows."""
    parts = defaultdict(list)
    for part, *rest in rows:
        parts[part].append(rest)
    out, shap = {}, defaultdict(int)
    for part, members in parts.items():
        for order in permutations(range(len(filters))):
            left = members
            for k, f in enumerate(order):
                gone = [m for m in left if m[0] >> f & 1]
                left = [m for m in left if not m[0] >> f & 1]
                failing = sum(m[0] >> f & 1 for m in members)
                shap[part, f] += len(gone)
                out[part, "".join(filters[i] for i in order), k + 1] = (
                    f, len(left), len(gone), failing - len(gone), sum(m[0] == 1 << f for m in members),
                    sum(m[1] for m in gone), sum(m[2] for m in gone))
    return {k: (*v[1:], shap[k[0], v[0]]) for k, v in out.items()}


def as_dict(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_lattice_counts():
    for n in range(1, 7):
        reach, leave = filter_audit.lattice(n)
        for s in range(1 << n):
            size = s.bit_count()
            assert (reach[s], leave[s]) == (factorial(size), factorial(n - size))


@pytest.mark.parametrize("filters", ["A", "XY", "ABC", "ABCDE"])
def test_against_replay(spark, filters):
    rows = [(p, (7 * i * i + 3 * i) % (1 << len(filters)), i % 2, i % 5 == 0)
            for i in range(60) for p in ("", "en", "de")[:1 + i % 3]]
    rows = [(p, m, int(g), int(t)) for p, m, g, t in rows]
    judged = spark.createDataFrame(rows, "part string, mask int, good int, toxic int").repartition(3)
    assert as_dict(filter_audit.audit(judged, filters)) == replay(rows, filters)


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = {r[:3]: r[3:] for r in con.execute(oracle.ORACLE["op13_filter_audit"]).fetchall()}
    assert as_dict(queries.QUERIES["op13_filter_audit"](spark, SF)) == want


def test_edges(spark, awkward, empty, docs_of, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (6, None, None), (None, 1, 1), (9, 1, None)],
                                   "doc_id long, quality int, toxic int")
    judged = filter_audit.judge(awkward, labels)
    rows = [tuple(r) for r in judged.collect()]
    assert len(rows) == len(AWKWARD)
    assert as_dict(filter_audit.audit(judged)) == replay(rows, "ABCDE")
    empties = [r for r in rows if r[0] == "" or r[0] == "fr"]
    assert {r[1] & 15 for r in empties} == {1}      # no words: fails A only
    assert sum(r[1] >> 4 for r in rows) == 2        # ids 3 (empty as 2) and 7 (as 6); 1 and 1 are one id
    assert sum(r[2] for r in rows) == 3 and sum(r[3] for r in rows) == 2
    assert filter_audit.audit(filter_audit.judge(empty, labels)).count() == 0
    assert filter_audit.judge(awkward, labels.limit(0)).where("good + toxic > 0").count() == 0
    # a text held by a third of the rows takes the salted path; null ids neither fail nor cause E
    monkeypatch.setattr(filter_audit, "HOT_TEXT", 100)
    many = [(k if k % 9 else None, "one text for all" if k % 3 == 0 else f"text {k}", "en", "s", 0) for k in range(900)]
    got = filter_audit.judge(docs_of(many), labels).groupBy(
        ((filter_audit.F.col("mask").bitwiseAND(16)) > 0).alias("e")).count().collect()
    assert {r.e: r["count"] for r in got} == {True: 199, False: 701}
    with pytest.raises(ValueError):
        filter_audit.audit(judged, "AAB")
