"""Remove byte strings that a document of a smaller id holds too (suffix-array dedup).

A byte goes if a ``length``-byte string over it also starts in a document with
a smaller id. The work runs over shards of about 4 MB of text:

1. Documents are packed into shards, written once (compressed) to the shared
   checkpoint folder, so every later step sees the same shards.
2. Each shard's strings are covered by anchors: the smallest hash of a
   ``SEED``-byte piece within each string. Equal strings have equal anchors, so
   only strings whose anchor occurs in two documents can repeat. Anchors meet
   by hash, five bytes each, and the repeated ones go back to their shards.
3. Each shard builds the suffix array of the candidate bytes whose anchor it
   has twice (Larsson-Sadakane refinement up to ``length``) and the common
   prefixes of neighbours (Kasai). Suffixes that share ``length`` bytes are one
   string; each distinct run of strings under one anchor leaves the shard once,
   with its smallest id. A run alone under its anchor is distinct as it is.
4. Runs meet by anchor. Equal runs of all shards are folded to one with the
   smallest id. Where an anchor is left with different runs, their strings are
   merged into one sorted list with their smallest ids; elsewhere the run's id
   is that of all its strings. The smallest ids return to the shards.
5. Each shard marks its bytes.

Runs and strings meet by 64-bit hash and are then compared byte by byte; string
hashes that stand for two strings are resolved by their bytes, runs that a
common hash keeps apart meet by their strings.

An anchor of ``HOT`` shards or more would bring too many runs together: its
strings travel one by one, as hashes only, and meet by them, at most one a shard.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercraft.llm.text import col, whole
from tiercraft.llm.vec import POWERS, mix, range_hashes
from tiercraft.session import ensure_checkpoint_dir

LENGTH, SEED = 50, 24
SHARD_BYTES, BUCKET_BYTES, BUCKETS, HOT = 4 << 20, 8 << 20, 128, 1000
_PIECE = 1 << 18
_LANES = 8192
_RESIDUE_BITS = 40
_CODEC = pa.Codec("zstd", compression_level=3)
_WINDOWS = 1 << 20

_SHARD = "shard bigint, n_bytes bigint, ids array<bigint>, sizes array<bigint>, data binary"
_MESSAGE = "kind int, dest bigint, origin bigint, data binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], np.int64)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    raw = _CODEC.decompress(data[8:], size, asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2)
    out, at = [], 8 + 16 * n
    for char, count in head.tolist():
        kind = np.dtype(chr(char))
        out.append(np.frombuffer(raw, kind, count, at))
        at += count * kind.itemsize
    return out


def _rows(schema: list[str], columns: list[list], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema)


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return _rows(["kind", "dest", "origin", "data"], [list(c) for c in zip(*rows, strict=True)] or [[]] * 4,
                 [pa.int32(), pa.int64(), pa.int64(), pa.binary()])


# -- 1. shards


def pack_shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, held, k
            row = {"shard": [(part << 32) | k], "n_bytes": [held], "ids": [ids],
                   "sizes": [[len(t) for t in texts]],
                   "data": [_pack(np.frombuffer(b"".join(texts), np.uint8))]}
            ids, texts, held, k = [], [], 0, k + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("shard", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())),
                ("sizes", pa.list_(pa.int64())), ("data", pa.binary())]))
        for batch in batches:
            for i, t in zip(batch.column("id"), batch.column("text").cast(pa.binary()), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py())
                held += len(texts[-1])
                if held >= limit:
                    yield flush()
        if ids:
            yield flush()
    return run


# -- 2. anchors


def _least_hashes(data: np.ndarray, seed: int, width: int) -> np.ndarray:
    """The smallest of ``width`` consecutive hashes of ``seed``-byte pieces, for every place."""
    POWERS.need(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * POWERS.up[:len(data)], out=sums[1:])
        low = mix((sums[seed:] - sums[:-seed]) * POWERS.down[:len(data) - seed + 1])
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:span - width], low[width - span:]) if width > span else low


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each run of windows under one anchor.

    A window is a start of ``length`` bytes inside one text; its anchor is the
    smallest mixed hash of the ``seed``-byte pieces in it.
    """
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = length - seed + 1
    low = np.empty(len(data) - length + 1, np.uint64)
    for at in range(0, len(low), _PIECE):  # piece by piece, for bounded memory
        low[at:at + _PIECE] = _least_hashes(data[at:at + _PIECE + length - 1], seed, width)
    inside = np.zeros(len(low) + 1, np.int8)
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    np.add.at(inside, offsets[:-1][count > 0], 1)
    np.add.at(inside, (offsets[:-1] + count)[count > 0], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    change = np.ones(len(low) + 1, bool)
    change[1:-1] = (low[1:] != low[:-1]) | ~inside[:-1]
    change[offsets[:-1][count > 0]] = True
    change[:-1] &= inside
    # A run ends where the next starts or where the windows of its text end.
    stop = np.zeros(len(low) + 1, bool)
    stop[1:] = inside & np.concatenate([change[1:-1] | ~inside[1:], [True]])
    start = np.flatnonzero(change[:-1])
    count = np.flatnonzero(stop) - start
    # A text that repeats itself keeps its anchor for long: its runs are cut, so that
    # the first and the last string of a run always cover it.
    pieces = -(-count // width)
    nth = _expand(np.zeros(len(count), np.int64), pieces)
    count = np.minimum(np.repeat(count, pieces) - nth * width, width)
    start = np.repeat(start, pieces) + nth * width
    return low[start], start, count


def _keys(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (high) and 40-bit residue (low) of each anchor."""
    bucket = (anchor >> np.uint64(_RESIDUE_BITS)) % np.uint64(buckets)
    return (bucket << np.uint64(_RESIDUE_BITS)) | (anchor & np.uint64((1 << _RESIDUE_BITS) - 1))


def _five(residue: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(residue.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).ravel()


def _eight(five: np.ndarray) -> np.ndarray:
    out = np.zeros((len(five) // 5, 8), np.uint8)
    out[:, :5] = five.reshape(-1, 5)
    return out.ravel().view("<u8")


def _shard(ids: list[int], sizes: list[int], data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array(ids, np.int64), np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64),
            _unpack(data)[0])


def shard_anchors(buckets: int):
    """Per shard and bucket: the shard's distinct anchors, and which of them occur in two of its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in ("shard", "ids", "sizes", "data")}
                ids, offsets, data = _shard(r["ids"], r["sizes"], r["data"])
                anchor, start, _ = window_runs(data, offsets)
                if not len(anchor):
                    continue
                key = _keys(anchor, buckets)
                owner = ids[np.searchsorted(offsets, start, "right") - 1]
                order = np.argsort(key)
                key, owner = key[order], owner[order]
                lead = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)) != 0)
                twice = np.minimum.reduceat(owner, lead) < np.maximum.reduceat(owner, lead)
                key = key[lead]
                bucket = (key >> np.uint64(_RESIDUE_BITS)).astype(np.int64)
                edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                yield pa.RecordBatch.from_arrays(_messages([
                    (0, int(bucket[a]), r["shard"],
                     _five(key[a:b]).tobytes() + np.packbits(twice[a:b]).tobytes())
                    for a, b in zip(edge[:-1], edge[1:], strict=True)]).combine_chunks().to_batches()[0].columns,
                    ["kind", "dest", "origin", "data"])
    return run


def repeated_anchors(hot_shards: int):
    """For one bucket: to each shard, its anchors that occur in two documents, the hot ones marked."""
    def run(table: pa.Table) -> pa.Table:
        origin, keys, twice = [], [], []
        for o, d in zip(table.column("origin"), table.column("data"), strict=True):
            raw = np.frombuffer(d.as_py(), np.uint8)
            n = len(raw) * 8 // 41  # five bytes and a bit each
            while n * 5 + (n + 7) // 8 < len(raw):
                n += 1
            keys.append(_eight(raw[:5 * n]))
            twice.append(np.unpackbits(raw[5 * n:], count=n))
            origin.append(np.full(n, o.as_py(), np.int64))
        key, flag, shard = np.concatenate(keys), np.concatenate(twice), np.concatenate(origin)
        order = np.argsort(key)
        key, flag, shard = key[order], flag[order], shard[order]
        lead = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)) != 0)
        count = np.diff(lead, append=len(key))
        again = (count > 1) | (np.maximum.reduceat(flag, lead) > 0)
        keep = np.repeat(again, count)
        hot = np.repeat(count >= hot_shards, count)[keep]
        key, shard = key[keep], shard[keep]
        order = np.lexsort((key, shard))
        key, shard, hot = key[order], shard[order], hot[order]
        edge = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(1, np.int64)
        bucket = table.column("dest")[0].as_py()
        return _messages([(1, int(shard[a]), bucket, _pack(_five(key[a:b]), hot[a:b]))
                          for a, b in zip(edge[:-1], edge[1:], strict=True)])
    return run


# -- 3. suffix arrays


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number (zeros after the end)."""
    ext = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | ext[k:k + len(data)]
    return out


def _word_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``at`` on, all inside ``data``, as a little-endian number."""
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))[at]


def _order(key: np.ndarray, bound: int) -> np.ndarray:
    """Places of ``key`` (below ``bound``) in ascending order; where key and place fit one number, that is sorted."""
    bits = max(1, (len(key) - 1).bit_length())
    if bound.bit_length() + bits > 63:
        return np.argsort(key)
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first ``depth`` bytes or more (Larsson-Sadakane).

    Suffixes are ordered by eight bytes, then each group of equals is refined by
    the group numbers ``h`` bytes on, and ``h`` doubles; settled groups rest. Besides
    the order: the group numbers at its end, those before the last refinement, and
    how many bytes the latter stand for (less than ``depth``).
    """
    n = len(data)
    word = _words(data)
    sa = np.argsort(word)
    fresh = np.ones(n, bool)
    fresh[1:] = word[sa[1:]] != word[sa[:-1]]
    rank = np.empty(n + 1, np.int64)
    lead = np.flatnonzero(fresh)
    size = np.diff(lead, append=n)
    rank[sa] = np.repeat(lead, size)
    rank[n] = -1
    slots = np.flatnonzero(np.repeat(size > 1, size))
    h, before, known = 8, rank, 8
    while h < depth and len(slots):
        before, known = rank.copy(), h
        p = sa[slots]
        key = rank[p] * (n + 1) + rank[np.minimum(p + h, n)] + 1
        order = _order(key, (n + 1) * (n + 1))
        p, key = p[order], key[order]
        sa[slots] = p
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lead = np.flatnonzero(new)
        size = np.diff(lead, append=len(key))
        rank[p] = np.repeat(slots[lead], size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return sa, rank[:-1], before[:-1], known


def common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int, at: np.ndarray, known: int) -> np.ndarray:
    """Common prefix of each suffix of ``at`` (text places, ascending) with the one before it in
    ``sa``, up to ``depth``; ``known`` bytes are common to each such pair.

    Kasai's scan: going from one place to the next a common prefix shrinks by
    one at most. Many stretches of the text are scanned side by side. The order
    is true for ``depth`` bytes only, so the prefix is carried over just where
    the predecessor's next suffix still comes first.
    """
    n = len(data)
    word = _words(data)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = sa[place[at] - 1]
    out = np.zeros(len(at), np.int64)
    lane = max(1, -(-len(at) // _LANES))
    k = np.arange(0, len(at), lane)
    stop = np.minimum(k + lane, len(at))
    h = np.full(len(k), known, np.int64)
    while len(k):
        i, j = at[k], before[k]
        room = np.minimum(n - np.maximum(i, j), depth)
        there = h < room
        x = word[np.minimum(i + h, n - 1)] ^ word[np.minimum(j + h, n - 1)]
        same = np.zeros(len(k), np.int64)
        for q in range(1, 9):
            same += x < np.uint64(1 << (64 - 8 * q)) if q < 8 else x == 0
        h = np.where(there, np.minimum(h + same, room), np.minimum(h, room))
        more = there & (same == 8) & (h < room)
        out[k[~more]] = h[~more]
        nxt = np.minimum(k + 1, len(at) - 1)
        carried = (at[nxt] == i + 1) & (j + 1 < n) & (place[np.minimum(j + 1, n - 1)] < place[np.minimum(i + 1, n - 1)])
        h = np.where(more, h, np.where(carried, np.maximum(h - 1, known), known))
        k = np.where(more, k, k + 1)
        left = k < stop
        k, stop, h = k[left], stop[left], h[left]
    return out


def string_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number per start, equal for equal ``length``-byte strings.

    Only the bytes under the starts enter the suffix array.
    """
    cover = np.zeros(len(data) + 1, np.int8)
    cover[starts] = 1
    cover[starts + length] -= 1     # a start counts once, so ``length`` of them cover a byte at most
    used = np.cumsum(cover[:-1], dtype=np.int32) > 0
    text = data[used]
    at = (np.cumsum(used, dtype=np.int32) - 1)[starts]  # a string's bytes are all used, so it stays in one piece
    sa, rank, coarse, known = suffix_array(text, length)
    # Neighbours of one last group share the string; those whose groups parted before the last
    # refinement do not. Between them, the common prefix decides.
    new = np.ones(len(text), bool)
    new[1:] = rank[sa[1:]] != rank[sa[:-1]]
    open_ = np.flatnonzero(new[1:] & (coarse[sa[1:]] == coarse[sa[:-1]])) + 1
    places = np.sort(sa[open_])
    short = np.zeros(len(text), bool)
    short[places] = common_prefixes(text, sa, length, places, known) < length
    new[open_] = short[sa[open_]]
    number = np.empty(len(text), np.int64)
    number[sa] = np.cumsum(new)
    return number[at]


def _expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for ``count`` places each."""
    total = np.concatenate([[0], np.cumsum(count)])
    return np.arange(total[-1]) - np.repeat(total[:-1] - start, count)


def _together(key: np.ndarray) -> np.ndarray:
    """Whether another place holds the same key."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def shard_candidates(buckets: int):
    """Per shard: its distinct candidate runs to their buckets, and to itself where they lie."""
    def run(key, shard_table: pa.Table, found: pa.Table) -> pa.Table:
        if not shard_table.num_rows or not found.num_rows:
            return _messages([])
        row = shard_table.to_pylist()[0]
        ids, offsets, data = _shard(row["ids"], row["sizes"], row["data"])
        wanted, hot_keys = [], []
        for bucket, message in zip(found.column("origin"), found.column("data"), strict=True):
            five, hot = _unpack(message.as_py())
            full = (np.uint64(bucket.as_py()) << np.uint64(_RESIDUE_BITS)) | _eight(five)
            wanted.append(full)
            hot_keys.append(full[hot.astype(bool)])
        wanted, hot_keys = np.sort(np.concatenate(wanted)), np.sort(np.concatenate(hot_keys))
        anchor, start, count = window_runs(data, offsets)
        anchor = _keys(anchor, buckets)
        mine = wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor
        anchor, start, count = anchor[mine], start[mine], count[mine]
        hot = np.zeros(len(anchor), bool)
        if len(hot_keys):
            hot = hot_keys[np.minimum(np.searchsorted(hot_keys, anchor), len(hot_keys) - 1)] == anchor
        windows = _expand(start, count)
        # A run that is alone under its anchor here equals no other run of the shard.
        inside = np.repeat(_together(anchor) | hot, count)
        number = np.arange(len(data), len(data) + len(windows))
        if inside.any():
            number[inside] = string_classes(data, windows[inside], LENGTH) - 1
        if len(hot_keys):  # runs under a hot anchor become runs of one window
            single = np.repeat(hot, count)
            start = np.concatenate([start[~hot], windows[single]])
            first = np.concatenate([[0], np.cumsum(count)])[:-1]
            lead = np.concatenate([first[~hot], np.flatnonzero(single)])
            count = np.concatenate([count[~hot], np.ones(int(single.sum()), np.int64)])
            dest = (anchor >> np.uint64(_RESIDUE_BITS)).astype(np.int64)[~hot]
            own = range_hashes(data, windows[single], windows[single] + LENGTH)
            dest = np.concatenate([dest, buckets + (own % np.uint64(buckets)).astype(np.int64)])
        else:
            lead = np.concatenate([[0], np.cumsum(count)])[:-1]
            dest = (anchor >> np.uint64(_RESIDUE_BITS)).astype(np.int64)
            own = np.zeros(0, np.uint64)
        owner = ids[np.searchsorted(offsets, start, "right") - 1]
        # The first and the last string of a run cover it: equal numbers are equal runs.
        a, b = number[lead], number[lead + count - 1]
        order = np.lexsort((count, b, a, _word_at(data, start).byteswap(), dest))  # neighbours in text order compress well
        same = np.ones(len(order), bool)
        for v in (dest, count, a, b):
            same[1:] &= v[order][1:] == v[order][:-1]
        same[0] = False
        distinct = np.cumsum(~same) - 1
        head = np.flatnonzero(~same)
        least = np.minimum.reduceat(owner[order], head)
        dest_d, start_d, count_d = dest[order][head], start[order][head], count[order][head]
        plain = int(np.searchsorted(dest_d, buckets))       # the strings under hot anchors follow
        hashes = own[order[head[plain:]] - (len(start) - len(own))]
        edge = np.flatnonzero(np.diff(dest_d, prepend=-1, append=-1))
        out = []
        size = count_d + LENGTH - 1
        begin = np.concatenate([[0], np.cumsum(size)])
        text, held, done = data[:0], 0, 0       # texts of the runs from ``held`` up to ``done``
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if dest_d[x] < buckets:
                if y > done:    # for many buckets at once
                    held, done = x, min(plain, max(y, int(np.searchsorted(begin, begin[x] + _PIECE))))
                    text = data[_expand(start_d[held:done], size[held:done])]
                message = _pack(least[x:y], text[begin[x] - begin[held]:begin[y] - begin[held]],
                                count_d[x:y].astype(np.uint8))
            else:
                message = _pack(least[x:y], hashes[x - plain:y - plain])
            out.append((2, int(dest_d[x]), row["shard"], message))
        # Where the runs lie, by place, and which of the windows sent out are theirs.
        sent = np.concatenate([[0], np.cumsum(count_d)])[:-1]
        place = np.empty(len(start), np.int64)
        place[order] = sent[distinct]
        by_start = np.argsort(start)
        out.append((3, row["shard"], row["shard"], _pack(
            np.diff(start[by_start], prepend=0).astype(np.uint32), count[by_start].astype(np.uint8),
            place[by_start].astype(np.uint32), dest_d[edge[:-1]], sent[edge[:-1]])))
        return _messages(out)
    return run


# -- 4. merging


def merged_strings(table: pa.Table) -> pa.Table:
    """For one bucket: the smallest id of every string of every shard's runs, back to the shard.

    A shard's message to itself passes through."""
    if table.column("kind")[0].as_py() == 3:
        return table.select(["kind", "dest", "origin", "data"])
    origin, bucket = table.column("origin").to_pylist(), table.column("dest")[0].as_py()
    parts = [_unpack(d.as_py()) for d in table.column("data")]
    edge = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist()
    low = np.concatenate([p[0] for p in parts])
    if len(parts[0]) == 2:      # strings under hot anchors, as hashes
        least = _smallest(np.concatenate([p[1] for p in parts]), low)
        return _messages([(4, s, bucket, _pack(least[x:y]))
                          for s, x, y in zip(origin, edge[:-1], edge[1:], strict=True)])
    text, count = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
    del parts
    least, first, strings = _smallest_of_runs(text, count, low)
    out = []
    for s, x, y in zip(origin, edge[:-1], edge[1:], strict=True):
        part = np.repeat(least[x:y], count[x:y])
        met = first[x:y] >= 0
        if met.any():
            part[np.repeat(met, count[x:y])] = strings[_expand(first[x:y][met], count[x:y][met])]
        out.append((4, s, bucket, _pack(part)))
    return _messages(out)


def _smallest_of_runs(text: np.ndarray, count: np.ndarray, low: np.ndarray
                      ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest ``low`` for the strings of runs that lie in ``text`` one after another.

    Equal runs are folded first. Runs that share a string share their anchor, so
    only where different runs are under one anchor do their strings meet. Per run:
    what holds for all its strings, and -1 or the place from which the third array
    has its strings one by one.
    """
    size = count + LENGTH - 1
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    order = np.argsort(_run_hashes(text, begin, size))
    new = np.ones(len(order), bool)
    new[1:] = count[order[1:]] != count[order[:-1]]
    for word in _run_words(text, begin[order], size[order]):
        new[1:] |= word[1:] != word[:-1]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    least = np.minimum.reduceat(low[order], lead)
    begin, size, many = begin[order[lead]], size[order[lead]], count[order[lead]]
    anchor = np.empty(len(lead), np.uint64)
    for at in range(0, len(lead), _PIECE // LENGTH):    # equal runs hold equal anchors: of the first string
        heads = begin[at:at + _PIECE // LENGTH, None] + np.arange(LENGTH)
        anchor[at:at + len(heads)] = _least_hashes(text[heads].ravel(), SEED, LENGTH - SEED + 1)[::LENGTH]
    met = np.flatnonzero(_together(anchor))
    met = met[np.argsort(anchor[met])]
    anchor = anchor[met]
    total = np.concatenate([[0], np.cumsum(many[met])])
    strings, at = np.empty(total[-1], np.int64), 0
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(met))
    while at < len(met):        # whole anchors, some million strings at a time
        to = int(ends[min(np.searchsorted(ends, np.searchsorted(total, total[at] + _WINDOWS)), len(ends) - 1)])
        part = met[at:to]
        own = text[_expand(begin[part], size[part])]
        place = _expand(np.concatenate([[0], np.cumsum(size[part])])[:-1], many[part])
        strings[total[at]:total[to]] = _smallest(
            range_hashes(own, place, place + LENGTH), np.repeat(least[part], many[part]), own, place)
        at = to
    first = np.full(len(lead), -1)
    first[met] = total[:-1]
    return least[kind], first[kind], strings


def _run_words(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of each run, eight at a time; a shorter run's last eight stand again."""
    for k in range(0, int(size.max()), 8):
        yield _word_at(text, begin + np.minimum(k, size - 8))


def _run_hashes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begin), np.uint64)
    for word in _run_words(text, begin, size):
        out = mix(out ^ word)
    return out


def _smallest(hashes: np.ndarray, low: np.ndarray, data: np.ndarray | None = None,
              place: np.ndarray | None = None) -> np.ndarray:
    """For each string the smallest ``low`` of its equals; given where the strings lie, equal hashes are compared."""
    order = np.argsort(hashes)
    string = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = string[1:] != string[:-1]
    wrong = string[:0] if data is None else _collisions(string, place[order], data)
    if len(wrong):      # equal hashes of different strings: these are told apart by their bytes
        apart, doubt = np.zeros(len(hashes), np.int64), np.isin(hashes, wrong)
        rows = data[place[doubt][:, None] + np.arange(LENGTH)]
        apart[doubt] = np.unique(rows, axis=0, return_inverse=True)[1].ravel() + 1
        order = np.lexsort((apart, hashes))
        new[1:] |= apart[order][1:] != apart[order][:-1]
    found = np.empty(len(order), np.int64)
    found[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return found


def _collisions(hashes: np.ndarray, place: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The sorted ``hashes`` that stand for different strings; ``place`` is where each string lies."""
    again = np.flatnonzero(hashes[1:] == hashes[:-1])
    one, other = place[again], place[again + 1]
    differ = np.zeros(len(again), bool)
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        differ |= _word_at(data, one + k) != _word_at(data, other + k)
    return np.unique(hashes[again[differ]])


# -- 5. marking


_RESULT = "id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def mark_shard(key, shard_table: pa.Table, messages: pa.Table) -> pa.Table:
    """One row per document of a shard."""
    ids, n_bytes, n_removed, spans, kept = [], [], [], [], []
    for row in shard_table.to_pylist():
        owner, offsets, data = _shard(row["ids"], row["sizes"], row["data"])
        edge = np.zeros(len(data) + 1, np.int64)
        by_kind: dict[int, list] = {3: [], 4: []}
        for k, o, d in zip(messages.column("kind"), messages.column("origin"), messages.column("data"), strict=True):
            by_kind[k.as_py()].append((o.as_py(), _unpack(d.as_py())))
        for _, (steps, count, sent, dests, base) in by_kind[3]:
            start, sent = np.cumsum(steps, dtype=np.int64), sent.astype(np.int64)
            least = np.full(int((sent + count).max()), np.iinfo(np.int64).max)
            first = dict(zip(dests.tolist(), base.tolist(), strict=True))
            for bucket, (low,) in by_kind[4]:
                least[first[bucket]:first[bucket] + len(low)] = low
            count = count.astype(np.int64)
            window = _expand(start, count)
            mine = np.repeat(owner[np.searchsorted(offsets, start, "right") - 1], count)
            window = window[least[_expand(sent, count)] < mine]
            edge += np.bincount(window, minlength=len(edge))
            edge[LENGTH:] -= np.bincount(window, minlength=len(edge))[:-LENGTH]
        gone = np.cumsum(edge[:-1]) > 0
        for k, i in enumerate(owner.tolist()):
            lo, hi = offsets[k], offsets[k + 1]
            g = gone[lo:hi]
            turn = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0))
            ids.append(i)
            n_bytes.append(int(hi - lo))
            n_removed.append(int(g.sum()))
            spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
            kept.append(data[lo:hi][~g].tobytes() if len(turn) else data[lo:hi].tobytes())
    return _rows(["id", "n_bytes", "n_removed", "spans", "kept"], [ids, n_bytes, n_removed, spans, kept],
                 [pa.int64(), pa.int64(), pa.int64(),
                  pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()])


def bucket_count(total: int, bucket_bytes: int) -> int:
    """Buckets for ``total`` bytes of text: of ``bucket_bytes``, but beyond ``BUCKETS`` of them of up to four times that.

    Every shard has a message for every bucket, so their number is the product of both."""
    return max(1, math.ceil(total / min(max(bucket_bytes, total / BUCKETS), 4 * bucket_bytes)))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES,
                hot_shards: int = HOT) -> DataFrame:
    """Per row of ``docs``: id (as ``id_col``), ``n_bytes``, ``n_removed``, ``spans`` (removed
    byte ranges of the UTF-8 text) and ``kept`` (the bytes left, joined).

    A byte goes if a 50-byte string over it also starts in a document with a
    smaller id; strings never cross documents and are judged on the input. Ids
    are integers. Null text: empty, nothing goes. Null id: nothing goes and the
    row removes nothing. Rows that repeat an id are one document and do not
    remove from each other; the strings of each are judged. Extra columns do
    not matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/suffix-dedup-{uuid.uuid4().hex}"
    base = docs.select(col(id_col).cast("long").alias("id"), whole(col(text_col)).alias("text"))
    base.where("id IS NOT NULL").mapInArrow(pack_shards(shard_bytes), _SHARD).write.parquet(f"{folder}/shards")
    shards = spark.read.schema(_SHARD).parquet(f"{folder}/shards")
    total = shards.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = bucket_count(total, bucket_bytes)
    anchors = shards.mapInArrow(shard_anchors(buckets), _MESSAGE)
    repeated = anchors.groupBy("dest").applyInArrow(repeated_anchors(hot_shards), _MESSAGE)
    by_shard = shards.groupBy("shard")
    runs = (by_shard.cogroup(repeated.withColumnRenamed("dest", "shard").groupBy("shard"))
            .applyInArrow(shard_candidates(buckets), _MESSAGE))
    # One shuffle takes runs to their buckets and each shard's own message along, the
    # next takes both back to the shards, whose shuffled texts are used a second time.
    back = runs.groupBy("kind", "dest").applyInArrow(merged_strings, _MESSAGE)
    marked = (by_shard.cogroup(back.withColumnRenamed("dest", "shard").groupBy("shard"))
              .applyInArrow(mark_shard, _RESULT))
    aside = base.where("id IS NULL").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"))
    return marked.unionByName(aside).withColumnRenamed("id", id_col)
