"""Token alignment against plain set intersections, and the fast encoder against the file's own library."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tiercraft.llm import queries, token_align

from conftest_llm import AWKWARD, LONG

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(public_tokenizers.path(token_align.BYTE_VOCAB))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_align.PIECE_VOCAB))
    al = token_align.aligner()

    def groups(text):
        """[(a ids, b ids)] of a text; none if the tokens do not spell it."""
        if not text:
            return []
        spaced = " " + text
        ids_a, ids_b = a.encode(spaced, add_special_tokens=False).ids, b.encode(text)
        if any(b"".join(names[i] for i in ids) != spaced.encode()
               for ids, names in ((ids_a, al.bytes_a), (ids_b, al.bytes_b))):
            return []
        ends = [np.cumsum([len(names[i]) for i in ids]).tolist() for ids, names in ((ids_a, al.bytes_a), (ids_b, al.bytes_b))]
        place_a, place_b = ({e: k + 1 for k, e in enumerate(es)} for es in ends)
        out, i, j = [], 0, 0
        for e in sorted(set(place_a) & set(place_b)):
            out.append((ids_a[i:place_a[e]], ids_b[j:place_b[e]]))
            i, j = place_a[e], place_b[e]
        return out
    return groups


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def digest(groups):
    return hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""


def test_query_against_plain_alignment(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    of = {d.doc_id: plain(d.text) for d in docs}
    count = Counter((x[-1], y[-1]) for g in of.values() for x, y in g)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    got = queries.QUERIES["op12_token_align"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        g = of[r.doc_id]
        links = [(x[-1], y[-1]) for x, y in g]
        assert tuple(r) == (r.doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                            sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), digest(g))


def test_odd_texts(plain):
    rng = random.Random(5)
    bits = [*"abXYZ  \n\t'’sté漢字😀▁0123٣½ªß\x1c\x1d\x85\xa0 ​́ﬁÅ\x00\r\x7f-_$€", "'s", "'re", "   ", "<s>", "</s>",
            "<unk>", "<|endoftext|>", "hello", " world", "<0x41>", "\n\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x24F), rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x2FFFF)]))
                      for _ in range(rng.randint(1, 30))) for _ in range(3000)] + [None, "", " ", "   ", "▁", "x" * 5000]
    got = token_align.align_texts(pa.array(texts, pa.string()), token_align.aligner()).to_pylist()
    for text, r in zip(texts, got, strict=True):
        g = plain(text)
        assert (r["n_groups"], r["digest"]) == (len(g), digest(g)), repr(text)


def test_every_entry_is_reachable():
    """What makes merging by id equal to merging by the file's rules."""
    own = Tokenizer.from_file(public_tokenizers.path(token_align.BYTE_VOCAB))
    rules = own.model
    al = token_align.aligner()
    names = {i: t for t, i in own.get_vocab().items()}
    for i in range(len(al.bytes_a) - 1):
        assert [t.id for t in rules.tokenize(names[i])] == [i]
    for k, piece in enumerate(al.bytes_b):
        assert b" " not in piece.lstrip(b" "), k


def test_common_ends_on_random_arrays():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        a, b = (np.flatnonzero(rng.random(n) < p) for p in rng.choice([0.02, 0.5, 0.98], 2))
        if rng.random() < 0.5:
            b = np.sort(np.where(rng.random(len(a)) < 0.95, a, -1))
            b = b[b >= 0]
        a, b = (np.append(v, n) for v in (a, b))
        both, at_a, at_b = np.intersect1d(a, b, return_indices=True)
        got_a, got_b = token_align.common_ends(a, b)
        assert got_a.tolist() == at_a.tolist() and got_b.tolist() == at_b.tolist()


def test_edges(awkward, empty):
    out = token_align.align(awkward)
    assert set(out.columns) == (set(awkward.columns) - {"text"}) | set(token_align.NAMES)
    rows = out.collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    for i in (2, 3):
        assert (by[i].n_a, by[i].n_b, by[i].n_groups, by[i].n_best, by[i].count_sum, by[i].groups_sha256) == (0,) * 5 + ("",)
    assert by[6].n_groups > 50_000 and by[6].groups_sha256 == by[7].groups_sha256 and len(LONG) > 200_000
    assert by[4].n_links == by[4].n_groups > 0
    assert token_align.align(empty).count() == 0
