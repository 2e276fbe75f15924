"""Quality rules on texts of a null, blank or unlisted language."""

import random

import duckdb
import pandas as pd
import pytest

from tiercraft.llm import quality_rules
from tiercraft.llm.oracle import ORACLE


def text(rnd, lang, n=150):
    """Words as a language has them: a third common ones."""
    common = quality_rules.COMMON_WORDS[lang]
    return " ".join(rnd.choice(common) if rnd.random() < 0.35 else
                    "".join(rnd.choice("abcdefgilmnoprstu") for _ in range(rnd.randrange(3, 10))) for _ in range(n))


def caseless(rnd, n=150):
    return " ".join("".join(rnd.choice("กขคงจชซดตถทนบปผพมยรลวสห") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    listed = [(i, text(rnd, lang), lang) for i, lang in enumerate(["en", "fr", "de", "es"] * 15)]
    odd = [(100 + i, text(rnd, lang), None) for i, lang in enumerate(["en", "fr", "de", "es"] * 3)]
    odd += [(200 + i, text(rnd, "fr"), "  ") for i in range(3)]
    odd += [(300 + i, caseless(rnd), "th") for i in range(20)] + [(330 + i, caseless(rnd), None) for i in range(5)]
    odd += [(340, text(rnd, "fr"), "oc"), (341, text(rnd, "fr"), "oc"),
            (350, " ".join(str(rnd.randrange(10**6)) for _ in range(150)), "th"),
            (351, " ".join(str(rnd.randrange(10**6)) for _ in range(150)), None)]
    return listed, odd


def judged(docs_of, rows):
    return {r.doc_id: r for r in quality_rules.judge(docs_of(rows)).collect()}


def test_texts_without_a_listed_language(docs_of, rows):
    listed, odd = rows
    got = judged(docs_of, listed + odd)
    assert len(got) == len(listed) + len(odd)
    assert {i for i, r in got.items() if not r.kept} == {350, 351}
    assert {got[i].word_distance for i in (300, 330, 340, 350)} == {0.0}
    # the nearest reference is the one of the text's own language
    same = judged(docs_of, listed + [(i, t, ["en", "fr", "de", "es"][i % 4]) for i, t, _ in odd if i < 200])
    for i in range(100, 112):
        assert abs(got[i].word_distance - same[i].word_distance) < 0.05


def test_they_stay_out_of_the_listed_references(docs_of, rows):
    listed, odd = rows
    alone, together = judged(docs_of, listed), judged(docs_of, listed + odd)
    assert all(together[i] == r for i, r in alone.items())


def test_corpus_without_any_listed_language(docs_of, rows):
    _, odd = rows
    got = judged(docs_of, odd)
    assert {i for i, r in got.items() if not r.kept} == {350}


@pytest.mark.parametrize("with_listed", [True, False])
def test_sql_follows_the_same_rule(docs_of, rows, with_listed):
    listed, odd = rows
    table = listed * with_listed + odd + [(400, "", None), (401, None, " "), (402, "ab cd", "oc")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(table, columns=["doc_id", "text", "lang"]))
    want = con.execute(ORACLE["op2_quality_rules"]).df().set_index("doc_id").sort_index()
    got = judged(docs_of, table)
    assert sorted(got) == list(want.index)
    for i, r in got.items():
        for c in want.columns:
            assert r[c] == (pytest.approx(want.at[i, c], abs=2e-6) if "distance" in c else want.at[i, c]), (i, c)
