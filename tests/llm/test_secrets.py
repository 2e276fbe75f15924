"""Secret scan: base spans against plain searches, verdicts against plain counts over all documents."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tiercraft.llm import queries, secret_scan

from conftest_llm import AWKWARD

SF = "/root/testdata/sf0.01"


def base(text):
    """The contract's matches by plain patterns: leftmost, dropped if too short, no retries."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                         r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end(), m[2]))
    out += [(m.start(), 1, "access", m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_query_against_plain_search(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_secrets"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(docs) == len(got)
    holders = defaultdict(set)
    for d in docs:
        for *_, value in base(d.text or ""):
            holders[value].add((d.source, d.doc_id))
    some = 0
    for d in docs:
        want, r = base(d.text or ""), got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[2] == k for w in want) for k in secret_scan.BASE_KINDS)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e, _ in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        kept = [s for s in r.spans.split(",") if s.split(":")[0] in secret_scan.BASE_KINDS]
        assert ",".join(kept) == joined
        copied = [v for *_, v in want if len({o for o, _ in holders[v]}) >= 3 or len(holders[v]) >= 100]
        assert r.n_example == len(copied)
        some += len(want)
    assert some > 10


def test_random_texts_equal_plain_search():
    rng = random.Random(3)
    bits = ["password", "PASSWD", "api_key", "apikey", "Token", "secret", "=", " = ", ":", '"', "'", " ", "AKIA", "AKIAIOSF",
            "ODNN7EXAMPLE", "deadbeef", "0123456789abcdef", "x", "-", ".", "\n", "é", "ſecret", "toKen", "abcdefgh12"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        found = [(s, k, e) for k, s, e, _, _ in secret_scan.find(text) if k < 3]
        assert found == [(s, k, e) for s, k, _, e, _ in base(text)], text


OWN, COPIED = "q9Zr4Tb7Xw2Lk8Vd1Hs6Jm3P", "Zk4Qw8Er2Ty6Ui1Op9As5Df7G"


def rows_of():
    rows = [(1, f"key {OWN} here", "en", "a"), (2, f"again {OWN}", "en", "a")]
    rows += [(10 + k, f"copied {COPIED}\ntoken = {COPIED}", "en", f"owner{k}") for k in range(3)]
    rows += [(20, "login https://bob:hunter22xY@example.net/", "en", "b"), (21, "token=aaaaaaaaaaaa", "en", "c"),
             (22, f"password: {OWN}", "en", "a")]
    return rows


def test_ownership_decides(docs_of):
    got = {r.doc_id: [(s.kind, s.verdict) for s in r.secrets]
           for r in secret_scan.find_secrets(docs_of([(*r, 0) for r in rows_of()])).collect()}
    assert got[1] == got[2] == [("blob", "owned")]
    assert got[10] == got[11] == got[12] == [("assign", "example")]   # the bare copy is not listed
    assert got[20] == [("login", "owned")] and got[21] == [("assign", "dull")] and got[22] == [("assign", "owned")]


def test_hot_value_takes_the_salted_path(docs_of, monkeypatch):
    monkeypatch.setattr(secret_scan, "HOT_VALUE", 50)
    rows = [(k, f"token={COPIED}" if k % 3 == 0 else f"secret: {k:04d}{OWN}", "en", f"o{k % 7}", 0) for k in range(900)]
    got = secret_scan.find_secrets(docs_of(rows)).collect()
    assert len(got) == 900 and all(len(r.secrets) == 1 for r in got)
    assert {s.verdict for r in got for s in r.secrets if r.doc_id % 3 == 0} == {"example"}
    assert {s.verdict for r in got for s in r.secrets if r.doc_id % 3} == {"owned"}


def test_edges(awkward, empty, spark):
    out = secret_scan.find_secrets(awkward)
    assert set(out.columns) == (set(awkward.columns) - {"text"}) | {"secrets"}
    assert out.count() == len(AWKWARD) and {len(r.secrets) for r in out.collect()} == {0}
    assert secret_scan.find_secrets(empty).count() == 0
    rows = [(None, f"token={OWN}", None, None, None)] * 2 + [(5, None, "en", None, 1), (5, "", "en", "s", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(len(r.secrets) for r in secret_scan.find_secrets(odd).collect()) == [0, 0, 1, 1]


@pytest.mark.parametrize("text", ["token" + " " * 200_000, "eyJ" * 70_000, "a1B" * 70_000, "://a:" * 40_000,
                                  "-----BEGIN PRIVATE KEY-----" + "A " * 100_000, "AKIA" * 50_000, "0" * 200_000])
def test_very_long_texts(text):
    assert secret_scan.find(text) is not None
