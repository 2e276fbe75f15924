"""Suffix-array dedup: runs that are equal, or alone under their anchor, cost no work per string."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from test_brute import removed

from tiercraft.llm import suffix_dedup as sd


def shard_of(k, docs):
    texts = [t for _, t in docs]
    return pa.table({"shard": pa.array([k], pa.int64()), "n_bytes": pa.array([sum(map(len, texts))], pa.int64()),
                     "ids": pa.array([[i for i, _ in docs]], pa.list_(pa.int64())),
                     "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                     "data": pa.array([sd._pack(np.frombuffer(b"".join(texts), np.uint8))], pa.binary())})


def of(table, column, value):
    return table.filter(pc.equal(table[column], value))


def steps(shards, buckets=1, hot=1000):
    """The steps of ``dedup_bytes`` in this process: (id, text, removed bytes)."""
    tables = [shard_of(k, docs) for k, docs in enumerate(shards)]
    anchors = pa.concat_tables(pa.Table.from_batches(sd.shard_anchors(buckets)(t.to_batches())) for t in tables)
    found = pa.concat_tables(sd.repeated_anchors(hot)(of(anchors, "dest", b)) for b in pc.unique(anchors["dest"]))
    runs = pa.concat_tables(sd.shard_candidates(buckets)(None, t, of(found, "dest", k)) for k, t in enumerate(tables))
    sent = of(runs, "kind", 2)
    back = pa.concat_tables([of(runs, "kind", 3), *(sd.merged_strings(of(sent, "dest", b)) for b in pc.unique(sent["dest"]))])
    out = []
    for k, (t, docs) in enumerate(zip(tables, shards, strict=True)):
        for (i, text), spans in zip(docs, sd.mark_shard(None, t, of(back, "dest", k))["spans"].to_pylist(), strict=True):
            gone = bytearray(len(text))
            for s in spans:
                gone[s["start"]:s["end"]] = b"\1" * (s["end"] - s["start"])
            out.append((i, text, bytes(gone)))
    return out


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(n)).encode()


def test_copies_in_other_shards_need_no_string_compared(monkeypatch):
    rnd = random.Random(11)
    texts = [prose(rnd, 120) for _ in range(12)]
    shards = [[(10 * k + i, t) for i, t in enumerate(texts)] for k in (2, 0, 1)]
    seen = []
    classes, smallest = sd.string_classes, sd._smallest
    monkeypatch.setattr(sd, "string_classes", lambda d, starts, n: seen.append(len(starts)) or classes(d, starts, n))
    monkeypatch.setattr(sd, "_smallest", lambda h, *a: seen.append(len(h)) or smallest(h, *a))
    got = steps(shards)
    assert sorted(got) == removed([x for s in shards for x in s])
    assert sum(map(sum, (g for _, _, g in got))) == 2 * sum(map(len, texts))
    assert sum(seen) == 0       # every string of every shard before


@pytest.mark.parametrize("collide", [False, True])
def test_runs_that_differ_meet_by_their_strings(monkeypatch, collide):
    if collide:     # equal runs no longer lie side by side, and different ones have one hash
        monkeypatch.setattr(sd, "_run_hashes", lambda text, begin, size: np.zeros(len(begin), np.uint64))
    monkeypatch.setattr(sd, "_WINDOWS", 100)        # several parts
    rnd = random.Random(12)
    passages = [prose(rnd, n) for n in (9, 15, 60)] + [b"z" * 70, b"ab" * 90]
    docs = [(i, b"".join((prose(rnd, rnd.randrange(20)), rnd.choice(passages), prose(rnd, rnd.randrange(20)),
                          rnd.choice(passages)))) for i in range(80)]
    docs += [(i, docs[i - 200][1]) for i in range(200, 220)] + [(3, docs[5][1]), (-4, docs[6][1]), (300, b""), (301, b"z" * 49)]
    rnd.shuffle(docs)
    assert sorted(steps([docs[k::4] for k in range(4)])) == sorted(removed(docs))


def test_messages_do_not_grow_with_the_square_at_once():
    mb = 1 << 20
    assert [sd.bucket_count(n * mb, 8 * mb) for n in (0, 1, 8, 9, 864, 1024)] == [1, 1, 1, 2, 108, 128]
    assert [sd.bucket_count(n * mb, 8 * mb) for n in (2048, 4096, 10240)] == [128, 128, 320]   # 256, 512, 1280 before
    assert sd.bucket_count(1 << 40, 8 * mb) == (1 << 40) // (32 * mb)


def test_hot_strings_of_a_shard_are_hashed_once(monkeypatch):
    rnd = random.Random(13)
    line = prose(rnd, 40)
    docs = [(i, b" ".join((prose(rnd, rnd.randrange(30)), line, prose(rnd, rnd.randrange(30))))) for i in range(30)]
    shards = [docs[k::3] for k in range(3)]
    calls, plain = [], sd.range_hashes
    monkeypatch.setattr(sd, "range_hashes", lambda data, *a: calls.append(len(data)) or plain(data, *a))
    got = steps(shards, buckets=50, hot=3)
    assert sorted(got) == removed(docs) and sum(map(sum, (g for _, _, g in got))) >= 29 * len(line)
    whole = [sum(len(t) for _, t in s) for s in shards]
    assert [calls.count(n) for n in whole] == [1, 1, 1]     # once for each of the 50 buckets before
