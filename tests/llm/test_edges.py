"""Nulls, empty and very long texts, repeated rows, empty tables, clashing extra columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tiercraft.llm import (decontaminate, line_dedup, mixing, near_dedup, pii, quality_crf, quality_rules,
                           suffix_dedup, token_counts, url_filter)

from conftest_llm import AWKWARD, EXTRA, LONG

FIRST = AWKWARD[0][1]


def test_suffix_dedup(awkward, empty):
    rows = suffix_dedup.dedup_bytes(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {(r.doc_id, r.n_bytes): r for r in rows}
    assert got[7, len(LONG)].n_removed == len(LONG) and bytes(got[7, len(LONG)].kept) == b""
    # a run of one byte repeats only within itself: the smallest id keeps all of it
    assert got[6, len(LONG)].n_removed == 0
    assert [r.n_removed for r in rows if r.doc_id in (None, 2, 3, 4)] == [0, 0, 0, 0]
    assert {r.n_removed for r in rows if r.doc_id == 1} == {0}  # one document, given twice
    assert suffix_dedup.dedup_bytes(empty).count() == 0


def test_quality_rules(awkward, empty):
    got = quality_rules.judge(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    for i in (2, 3, 4):
        assert (by[i].n_words, by[i].word_chars, by[i].base_failed, by[i].kept) == (0, 0, True, False)
    assert by[6].n_repeat_words > 50_000 and by[6].base_failed
    assert quality_rules.judge(empty).count() == 0


def test_line_dedup(awkward, empty):
    out = line_dedup.dedup_lines(awkward)
    assert set(out.columns) == set(awkward.columns) | {"n_lines", "n_dropped"}
    got = out.collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert [r.text for r in got if r.doc_id == 1] == [FIRST, FIRST]
    assert by[None].text == AWKWARD[4][1] and by[None].n_dropped == 0
    assert (by[5].text, by[5].n_lines, by[5].n_dropped) == ("other words follow here", 2, 1)
    assert by[2].text == "" and by[2].n_lines == 1 and by[3].n_lines == 1
    assert by[7].text == "" and by[7].n_dropped == 1 and by[6].n_dropped == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_threshold(docs_of):
    rows = [(i, "a line held by three documents") for i in (3, 1, 2)] + [(4, "a line of two documents"),
                                                                       (5, "a line of two documents")]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs_of(rows), min_docs=3).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_mixing(awkward, empty):
    got = mixing.copies(awkward).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.copies <= 2 for r in got)
    assert all(r["size"] == 0 for r in got if r.doc_id in (2, 3, 4))
    again = mixing.copies(awkward.repartition(5)).collect()
    key = lambda rs: sorted((r.doc_id or -1, r["size"], r.copies) for r in rs)
    assert key(got) == key(again)
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns and out.count() == sum(r.copies for r in got)
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_decontaminate(spark, awkward, empty):
    bench = spark.createDataFrame([(1, FIRST), (2, None), (None, "x"), (4, ""), (5, "one"), (1, FIRST)],
                                  "item_id long, text string")
    found = decontaminate.find_hits(awkward, bench)
    got = {r.doc_id: r for r in found.collect()}
    assert got[1]["items"] == ["1"] and len(got[1].hits) == 17 and got[1]["n_words"] == 17
    assert got[9]["items"] == ["5"] and got[2]["n_words"] == 0 and got[6].hits == []
    assert got[5].hits == []                    # eight words of a longer item are no window
    kept = decontaminate.decontaminate(awkward, bench)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [2, 3, 4, 5, 6, 7, 8]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(awkward, bench, remove="spans").collect()}
    assert cut[1] == "." and cut[9] == "" and cut[2] is None and cut[6] == LONG
    nothing = bench.limit(0)
    assert decontaminate.find_hits(awkward, nothing).where(F.size("hits") > 0).count() == 0
    assert decontaminate.find_hits(empty, bench).count() == 0


def test_token_counts(awkward, empty):
    out = token_counts.count_tokens(awkward, budgets=(3, 2048))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(AWKWARD)
    assert [got[i].n_tokens for i in (2, 3, 4)] == [0, 0, 0]
    assert got[9].n_tokens == 1 and list(got[9].words_within) == [1, 1]
    assert got[6].n_tokens == got[7].n_tokens > 60_000
    assert token_counts.count_tokens(empty).count() == 0


def test_quality_crf(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 1, 0), (8, 1, 1), (None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality_crf.fit(awkward, labels)
    got = quality_crf.score_documents(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[2] == by[3]                       # a null text is an empty one
    kept = quality_crf.keep_good(awkward, labels)
    assert kept.columns == awkward.columns
    unlabelled = quality_crf.fit(awkward, labels.limit(0))
    assert {r.score for r in quality_crf.score_documents(awkward, unlabelled).collect()} == {0.5}
    assert quality_crf.score_documents(empty, model).count() == 0
    assert quality_crf.fit(empty, labels).weights.any() == False  # noqa: E712


@pytest.mark.parametrize("words, similarity", [(3, 0.85), (5, 0.8)])
def test_near_dedup(awkward, empty, words, similarity):
    got = near_dedup.link_documents(awkward, words=words, similarity=similarity).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 6 and not by[7].kept and by[6].kept
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0
    assert all(by[i].component_id == i and by[i].kept for i in (2, 3, 4, 5, 8, 9))
    assert by[None].component_id is None and by[None].kept and by[9].n_shingles == 1
    kept = near_dedup.near_dedup(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 6, 8, 9] and ids.count(None) == 1
    assert near_dedup.link_documents(empty).count() == 0 and near_dedup.near_dedup(empty).count() == 0


def test_url_filter(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://Example.ORG/es/x?y#z"), (4, "http://a.example.org/en/12"),
            (5, "https://fr.site.com/fr/"), (6, "https://com/de/"), (7, "http://x.org"), (8, "http://evilorg/"),
            (9, "http://a.org?u=http://b.com/de/"), (3, "http://Example.ORG/es/x?y#z"), (None, ""),
            (10, "x://" + "a." * 500 + "org/" + "p" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for c in EXTRA:
        pages = pages.withColumn(c, F.lit("x"))
    rules = url_filter.rule_table(spark)
    out = url_filter.filter_urls(pages, rules).collect()
    assert len(out) == len(rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert got[1] == got[2] == got[None] == ("", "", None, "allow")
    assert got[3] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7] == ("x.org", "", None, "allow")
    assert got[8] == ("evilorg", "/", None, "allow") and got[9] == ("a.org", "", None, "allow")
    assert got[10][2:] == ("org/", "allow")
    nothing = url_filter.filter_urls(pages, rules.limit(0), default="block").collect()
    assert {r.verdict for r in nothing} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_pii(awkward, empty):
    out = pii.find_pii(awkward)
    got = {r.doc_id: r for r in out.collect()}
    text = AWKWARD[9][1]
    spans = {s["kind"]: text[s["start"]:s["end"]] for s in got[8].pii_spans}
    assert spans == {"email": "a.b@example.org", "ip": "10.0.0.1", "card": "4111 1111 1111 1111",
                     "phone": "+1 (555) 123-4567"}
    assert all(not got[i].pii_spans for i in (1, 2, 3, 4, 6, 7, 9))
    clean = {r.doc_id: r.text for r in pii.redact(awkward).collect()}
    assert clean[8] == "mail [EMAIL] or [IP], card [CARD], [PHONE] \U0001f600 é" and clean[6] == LONG
    assert pii.find_pii(empty).count() == 0 and hashlib.sha256(b"").hexdigest()
