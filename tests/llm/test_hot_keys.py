"""Keys of more than a thousand rows: the salted joins of line dedup and quality rules give the plain result."""

import math
import random
from collections import Counter

import pytest

from tiercraft.llm import line_dedup, quality_rules


def test_line_held_by_most_documents(docs_of):
    rnd = random.Random(8)
    lines = [f"line number {k} of the corpus" for k in range(60)]
    rows = []
    for i in range(2_600):
        parts = [f"own words {rnd.randrange(10 ** 9)} of it"]
        parts += ["  The Common Line of all  "] * (i % 2 + 1 if i % 3 else 0)
        parts += [rnd.choice(lines)] if i % 50 == 0 else []
        parts += ["short"] if i % 4 == 0 else []
        rnd.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    holders = {}
    for i, text in rows:
        for line in text.split("\n"):
            holders.setdefault(line.strip().lower(), set()).add(i)
    assert Counter(len(v) >= 1_000 for v in holders.values())[True] == 1

    def stays(i, line):
        key = line.strip().lower()
        return len(key) < 10 or len(holders[key]) < 2 or min(holders[key]) == i
    want = {i: "\n".join(x for x in text.split("\n") if stays(i, x)) for i, text in rows}
    got = line_dedup.dedup_lines(docs_of(rows, parts=7)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.text for r in got} == want
    assert all(r.n_lines - r.n_dropped == max(len(want[r.doc_id].split("\n")), 0) or not want[r.doc_id] for r in got)


def distance(p, q):
    """Jensen-Shannon distance of two histograms."""
    p, q = ([x / sum(h) for x in h] for h in (p, q))
    def half(a, b):
        return sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def test_unlisted_language_of_most_documents(docs_of):
    rnd = random.Random(9)
    rows = [(i, " ".join("".join(rnd.choice("abcdefghkl 0123,.") for _ in range(8)) for _ in range(60)),
             "xx" if i % 5 else "yy") for i in range(1_700)]
    docs = docs_of(rows, parts=7)
    chars = {r.doc_id: (r.reference, r.chars) for r in quality_rules.measure(docs).collect()}
    sums = {lang: [sum(c) for c in zip(*[h for k, h in chars.values() if k == lang], strict=True)]
            for lang in ("xx", "yy")}
    got = quality_rules.judge(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(1_700))
    for r in got:
        lang, own = chars[r.doc_id]
        assert r.char_distance == pytest.approx(distance(own, sums[lang]), abs=2e-6)
        assert r.word_distance == 0
