"""Scores by the words before a span, against plain Python; very many matches in one text."""

import random
import re
import time

from tiercraft.llm import pii

SCHEMA = "doc_id long, text string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
         "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"}


def plain_score(kind, text, start):
    near = text[max(0, start - pii.CONTEXT_CHARS):start].lower()
    bonus = pii.CONTEXT_BONUS if re.search(rf"\b(?:{pii.CONTEXT[kind]})\b", near) else 0.0
    return min(1.0, pii.START_SCORE[kind] + bonus)


def test_scores_follow_the_words_before(spark):
    rng = random.Random(11)
    parts = ["mail ", "contact: ", "x" * 47, " ", "é" * 30, "a.b@c.org", "me@d.net ", "SSN ", "taxpayer no ", "123-45-6789",
             " 321-54-9876 ", "\n", "𝒳" * 20, "Social Security", ", ", "z" * 60 + " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    some = 0
    for r in rows:
        got = {k: [(s.start, s.end, round(s.score, 9)) for s in r.pii_spans if s.kind == k] for k in PLAIN}
        for kind, pattern in PLAIN.items():
            want = [(m.start(), m.end(), round(plain_score(kind, r.text, m.start()), 9)) for m in re.finditer(pattern, r.text)]
            if kind == "ssn":
                want = [w for w in want if w[2] >= pii.MIN_SCORE]
            assert got[kind] == want, (kind, r.text)
            some += len(want)
    assert some > 200


def test_context_of_an_account_code(spark):
    code = "DE89370400440532013000"
    texts = [f"konto {code}", f"nothing {code}", f"bank {'x' * 60} {code}", f"{code} {code}"]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    scores = [[round(s.score, 2) for s in r.pii_spans if s.kind == "iban"] for r in rows]
    assert scores == [[1.0], [0.7], [0.7], [0.7, 0.7]]


def test_many_matches_cost_in_proportion(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "write to some.one@example.org " * n)], SCHEMA)
        t0 = time.time()
        assert len(pii.find_pii(docs).first().pii_spans) == n
        return time.time() - t0
    seconds(10)
    small, large = seconds(2000), seconds(20000)
    assert large < 40 * small + 5
