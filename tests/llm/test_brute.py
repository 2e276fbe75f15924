"""Operators against plain brute force, the library they must equal, or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SCHEMA
from pyspark.sql import functions as F

from tiercraft.llm import decontaminate, near_dedup, pii, quality_crf, suffix_dedup, token_counts
from tiercraft.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# -- 1


def removed(rows, length=50):
    """Per (id, bytes): the removed places, by a set of all strings of smaller ids."""
    out, seen, last, own = [], set(), None, set()
    for i, b in sorted(rows):
        if i != last:
            seen |= own
            own, last = set(), i
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            if s in seen:
                gone[p:p + length] = b"\1" * length
            else:
                own.add(s)
        out.append((i, b, bytes(gone)))
    return out


def check_removed(rows, got):
    want = sorted((i, len(b), sum(g), len(re.findall(b"\1+", g)), bytes(x for x, d in zip(b, g, strict=True) if not d))
                  for i, b, g in removed(rows))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000, "bucket_bytes": 20_000},
                                   {"shard_bytes": 2000, "bucket_bytes": 4000, "hot_shards": 2}])
def test_suffix_dedup_by_brute_force(spark, docs_of, sizes):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    passages = [" ".join(rnd.choice(words) for _ in range(n)) for n in (9, 12, 20, 60)]
    rows = []
    for i in range(120):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))]
        parts += [rnd.choice(passages) for _ in range(rnd.randrange(3))]
        rnd.shuffle(parts)
        rows.append((i * 7 % 120, rnd.choice((" ", "", "\n")).join(parts)))
    rows += [(200, "ab" * 400), (201, "x" + "ab" * 300), (202, "z" * 49), (203, "z" * 50), (204, "z" * 51)]
    got = suffix_dedup.dedup_bytes(docs_of(rows, parts=5), **sizes).collect()
    check_removed([(i, t.encode()) for i, t in rows], got)


def test_suffix_array_and_common_prefixes():
    rnd = np.random.default_rng(5)
    for text in (rnd.integers(97, 99, 3000), np.full(500, 97), np.tile(np.arange(97, 104), 90), rnd.integers(0, 256, 2000)):
        data = text.astype(np.uint8)
        raw = data.tobytes()
        sa, rank, coarse, known = suffix_dedup.suffix_array(data, 50)
        assert known in (8, 16, 32) and (rank[sa] == np.sort(rank)).all()
        cut = [raw[p:p + 50] for p in sa]
        assert cut == sorted(cut) and sorted(sa) == list(range(len(raw)))
        places = np.arange(len(sa))[np.arange(len(sa)) != sa[0]]
        got = dict(zip(places.tolist(), suffix_dedup.common_prefixes(data, sa, 50, places, 0).tolist(), strict=True))
        for k in range(1, len(sa)):
            a, b = raw[sa[k - 1]:][:50], raw[sa[k]:][:50]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert got[sa[k]] == n
            if len(raw) - max(sa[k - 1], sa[k]) >= 64:      # what the classes read off the group numbers
                assert (rank[sa[k]] == rank[sa[k - 1]]) == (raw[sa[k - 1]:][:64] == raw[sa[k]:][:64])
                assert (coarse[sa[k]] == coarse[sa[k - 1]]) == (raw[sa[k - 1]:][:known] == raw[sa[k]:][:known])
        starts = np.sort(rnd.choice(len(raw) - 50, 200))
        number = suffix_dedup.string_classes(data, starts, 50)
        strings = [raw[p:p + 50] for p in starts]
        assert len(set(zip(strings, number.tolist(), strict=True))) == len(set(strings)) == len(set(number.tolist()))


def test_colliding_hashes_are_told_apart(monkeypatch):
    rnd = np.random.default_rng(6)
    pool = rnd.integers(97, 100, (40, 60)).astype(np.uint8)
    messages, want = [], {}
    for shard in range(5):
        runs = [(int(i), int(rnd.integers(1, 12)), int(rnd.integers(0, 1000))) for i in rnd.choice(40, 20, replace=False)]
        text = np.concatenate([pool[i][:n + 49] for i, n, _ in runs])
        least, count = np.array([x for *_, x in runs]), np.array([n for _, n, _ in runs], np.uint8)
        messages.append((2, 7, shard, suffix_dedup._pack(least, text, count)))
        for i, n, x in runs:
            for k in range(n):
                s = pool[i][k:k + 50].tobytes()
                want[s] = min(want.get(s, 10 ** 9), x)
    table = suffix_dedup._messages(messages)
    plain = suffix_dedup.range_hashes
    for some in (plain, lambda *a: plain(*a) % np.uint64(5)):
        monkeypatch.setattr(suffix_dedup, "range_hashes", some)
        back = suffix_dedup.merged_strings(table)
        for shard, data in zip(back.column("dest").to_pylist(), back.column("data").to_pylist(), strict=True):
            _, text, count = suffix_dedup._unpack(messages[shard][3])
            got, begin = suffix_dedup._unpack(data)[0].tolist(), 0
            for n in count.tolist():
                strings = [text[begin + k:begin + k + 50].tobytes() for k in range(n)]
                assert [want[s] for s in strings] == [got.pop(0) for _ in range(n)]
                begin += n + 49


# -- 2 and 10: the parts SQL does not show


def test_pii_base_by_plain_patterns(spark, texts):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    def spans(t):
        return [f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, t) if ok(k, m.group())]
    rnd = random.Random(1)
    odd = ["".join(rnd.choice("ab1.9-@_ +()4é\U0001f600") for _ in range(rnd.randrange(5, 400))) for _ in range(300)]
    odd += ["a@b.cx_y@d.e", "_a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "0000000.1.2.300", "001.002.003.004", "4111-1111 11111111",
            "5 5", "+1 2 3 4 5 6 7 8 9", "+1.", "a@b", "@b.c", "9" * 5000, "a" * 20000 + "@x.y", "é@é.é a@b.é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in pii.find_pii(df).select("doc_id", pii.joined(pii.base_only(F.col("pii_spans"))).alias("s")).collect():
        assert r.s == ",".join(spans(odd[r.doc_id])), odd[r.doc_id]
    for r in QUERIES["op10_pii"](spark, SF).collect():
        found = spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(found).encode())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in found) for k in plain]


def test_pii_method_adds_checked_spans(spark):
    rows = [(1, "my iban is GB82 WEST 1234 5698 7654 32 thanks"), (2, "iban GB82 WEST 1234 5698 7654 33"),
            (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "social security 000-45-6789"),
            (6, "DE89370400440532013000")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [s["kind"] for s in r.pii_spans if s["kind"] in pii.ADDED_KINDS] for r in pii.find_pii(df).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: [], 6: ["iban"]}


# -- 5


def test_hits_by_brute_force_in_one_and_many_blocks(spark, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in bench.collect():
        w = word.findall(low(r.text))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(r.item_id))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for max_grams in (10**6, 1500):
        for r in decontaminate.find_hits(docs, bench, max_grams=max_grams).collect():
            w, hit, items = word.findall(low(texts[r.doc_id])), set(), set()
            for n in {len(k) for k in windows}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i:i + n]) in windows:
                        hit |= set(range(i, i + n))
                        items |= windows[tuple(w[i:i + n])]
            assert (r.n_words, list(r.hits), list(r["items"])) == (len(w), sorted(hit), sorted(items))


# -- 6


def test_tokens_equal_the_library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCAB))
    counter = token_counts.counter(token_counts.VOCAB)
    odd = ["", "  ", "hello<|endoftext|>World's it'LL <|startoftext|>x", "ΑΣ ΣΑΣ İstanbul ſ'ſ K é ñ 中文 12345 １２ ½ ²³",
           "a b\u0085c\x1cd\x1fe​f", "😀👨‍👩‍👧 x", "a" * 3000, "ab" * 300, "\x00", "!!??$$", "don't I'D 's'S", "𝔘nicode ﬁ"]
    all_texts = [*texts.values(), *odd]
    want = [len(e.ids) for e in library.encode_batch(all_texts, add_special_tokens=False)]
    tables = [counter.prefix_counts(t) for t in all_texts]
    assert [int(t[-1]) if len(t) else 0 for t in tables] == want
    # every prefix: the table equals encoding the words up to there
    text = "the quick brown fox's jumps over 12 lazy dogs!!! again and again"
    words = counter.word.findall(counter.normalise(text))
    for k in range(1, len(words) + 1):
        assert counter.prefix_counts(text)[k - 1] == len(library.encode(" ".join(words[:k]), add_special_tokens=False).ids)


# -- 7


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op7_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i in labels if i in rows and rows[i].held_out]
    assert np.mean([rows[i].predicted == labels[i] for i in held]) >= 0.95
    assert all(r.predicted == (r.score >= 0.7) for r in rows.values())


def test_chain_marginals_by_enumeration():
    rnd = np.random.default_rng(2)
    for steps in (1, 2, 5):
        unary, theta = rnd.normal(size=(1, steps)), rnd.normal(size=(2, 2))
        f, b = quality_crf.chain(unary, np.ones((1, steps), bool), theta)
        weight = np.zeros((steps, 2))
        for code in range(2 ** steps):
            y = [code >> k & 1 for k in range(steps)]
            s = np.exp(sum(unary[0, k] * y[k] for k in range(steps)) + sum(theta[y[k], y[k + 1]] for k in range(steps - 1)))
            for k in range(steps):
                weight[k, y[k]] += s
        assert np.allclose(1 / (1 + np.exp(-(f + b)[0])), weight[:, 1] / weight.sum(axis=1))


# -- 8


def components_of(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        grams = zip(*[w[k:] for k in range(words)], strict=False) if len(w) >= words else [tuple(w)] * bool(w)
        sets[i] = frozenset(grams)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, edits):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for size in (9, 30, 80, 150):
        group = [[rnd.choice(words) for _ in range(size)]]
        for _ in range(50):
            t = list(rnd.choice(group) if rnd.random() < 0.4 else group[0])
            for _ in range(rnd.choice(edits)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            group.append(t + [rnd.choice(words) for _ in range(rnd.choice((0, 0, 0, 2)))])
        docs += group
    rnd.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, "a b"), (901, "A  b"), (902, "c")]


@pytest.mark.parametrize("seed, words, percent, edits", [(1, 3, 85, (0, 1, 2, 4, 8)), (2, 5, 80, (1, 2, 3)), (3, 3, 85, (3, 4, 5, 12))])
def test_near_dedup_by_brute_force(docs_of, seed, words, percent, edits):
    rows = near_copies(seed, edits)
    got = near_dedup.link_documents(docs_of(rows), words=words, similarity=percent / 100).collect()
    want = components_of(rows, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_near_dedup_around_a_hot_hub(docs_of, monkeypatch):
    """One document near hundreds of others, some near each other only: all salted joins run."""
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 60)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    hub = [rnd.choice(words) for _ in range(120)]
    docs = [hub] * 80                                           # a class of copies
    for edits in [1] * 150 + [4, 5, 6] * 40 + [12] * 20:
        t = list(rnd.choice(docs) if edits == 5 else hub)
        for _ in range(edits):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        docs.append(t)
    docs += [[rnd.choice(words) for _ in range(60)] for _ in range(40)]
    rnd.shuffle(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = near_dedup.link_documents(docs_of(rows, parts=7), words=3, similarity=0.85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(rows, 3, 85)


def test_near_dedup_far_from_the_hub(docs_of, monkeypatch):
    """Families that share half a text with the hub, so buckets hold documents far from it and linked to each other."""
    monkeypatch.setattr(near_dedup, "NEAR", 0.99)
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 50)
    monkeypatch.setattr(near_dedup, "CELL_ROWS", 7)
    compared = []
    by_difference = near_dedup._by_difference
    monkeypatch.setattr(near_dedup, "_by_difference", lambda marked, *rest: compared.append(
        {r.whole: r["count"] for r in marked.groupBy("whole").count().collect()}) or by_difference(marked, *rest))
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    hub = [rnd.choice(words) for _ in range(100)]
    docs = [hub]
    for family in range(12):
        own = hub[:80] + [rnd.choice(words) for _ in range(20)] if family % 2 else (
            hub[:60] + [rnd.choice(words) for _ in range(40)])
        for _ in range(20):
            t = list(own)
            for _ in range(rnd.choice((0, 1, 2, 3, 5))):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            docs.append(t)
    docs += [[w if rnd.random() < 0.97 else rnd.choice(words) for w in hub] for _ in range(60)]
    rnd.shuffle(docs)
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    got = near_dedup.link_documents(docs_of(rows, parts=5), words=3, similarity=0.85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_of(rows, 3, 85)
    assert compared[0].get(True, 0) > 100       # the case occurs


def test_near_dedup_plans_stay_small(docs_of, monkeypatch):
    """No job carries the plans of several frames before it: the driver holds a task's record for each of its stages."""
    wide, settled = [], near_dedup.settled

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count(" Exchange ")
    monkeypatch.setattr(near_dedup, "settled", lambda df, *rest: wide.append(shuffles(df)) or settled(df, *rest))
    got = near_dedup.link_documents(docs_of(near_copies(5, (0, 1, 2, 4, 8))), words=3, similarity=0.85)
    assert shuffles(got) <= 4 and max(wide) <= 16, (shuffles(got), wide)


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        n = 2000
        both = rnd.integers(0, 2**63, int(n * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([both, rnd.integers(0, 2**63, n - len(both), dtype=np.uint64)]) * np.uint64(2))
                for _ in range(2)]
        regs = pa.array([near_dedup.registers(s).tobytes() for s in sets], pa.binary())
        size = pa.array([len(s) for s in sets])
        true = share / (2 - share)
        assert abs(near_dedup.estimate(regs[:1], regs[1:], size[:1], size[1:])[0].as_py() - true) < 0.15


# -- the pipeline


def test_pipeline_by_brute_force(spark, texts):
    import corpus_pipeline

    docs = spark.createDataFrame(spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect(), SCHEMA)
    good, lines, near, clean, mixed = (f for _, f in corpus_pipeline.STAGES)
    kept = good(spark, docs, SF).cache()
    model = quality_crf.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_crf.score_documents(docs, model).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}

    cut = lines(spark, kept, SF).cache()
    holders, want = {}, {}
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        for x in (r.text or "").split("\n"):
            holders.setdefault(key(x), r.doc_id)
    for r in kept.collect():
        parts = (r.text or "").split("\n")
        left = [x for x in parts if len(key(x)) < 10 or holders[key(x)] == r.doc_id]
        if len(left) == len(parts) or WORD.search("\n".join(left)):
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in cut.collect()} == want

    single = near(spark, cut, SF).cache()
    groups = components_of(sorted(want.items()), 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)

    fine = clean(spark, single, SF).cache()
    found = decontaminate.find_hits(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {r.doc_id for r in fine.collect()} == {r.doc_id for r in found if not r.hits or 20 * len(r.hits) < r["n_words"]}
    for df in (kept, cut, single, fine):
        assert df.columns == corpus_pipeline.COLUMNS

    taken = Counter(r.doc_id for r in mixed(spark, fine, SF).collect())
    size = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in fine.collect()}
    assert max(taken.values()) <= 2 and set(taken) <= set(size)
    total = sum(n for _, n in size.values())
    assert abs(sum(size[i][1] * k for i, k in taken.items()) - 1.5 * total) < 0.1 * total
    whole = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == taken
