"""Find and remove benchmark passages in training texts.

The normalised n-grams of the benchmark are a broadcast hash set; each task
slides a window over its texts' words, looks the window hashes up, and checks
every hit word for word. No shuffle. The set is bounded: a benchmark with more
than ``MAX_GRAMS`` n-grams is dealt into blocks by the hash of (item, n-gram).
Each block is broadcast for a pass of its own, which writes its hits by the
texts' 128-bit hashes and is released before the next; only then are the
texts shuffled, to be joined with the hits of all blocks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercraft.llm.text import col, fresh, without
from tiercraft.llm.vec import LOWER, byte_class, lists, range_hashes, text_slices, word_bounds
from tiercraft.session import ensure_checkpoint_dir

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased.
WORD = byte_class("".join(map(chr, range(128))), inverse=True) | byte_class(
    "0123456789abcdefghijklmnopqrstuvwxyz")
MAX_GRAMS = 1_000_000
_TABLE_BITS = 20


def _grams(n: int):
    """For mapInArrow over (item, text): each n-gram of an item, or all its words if fewer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, grams, sizes = [], [], []
            at = 0
            for data, offsets in text_slices(batch.column("text")):
                data = LOWER[data]
                start, end, first = word_bounds(data, offsets, WORD)
                for k in range(len(offsets) - 1):
                    words = [data[s:e].tobytes() for s, e in zip(
                        start[first[k]:first[k + 1]], end[first[k]:first[k + 1]], strict=True)]
                    size = min(n, len(words))
                    found = {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)} if size else ()
                    grams += found
                    sizes += [size] * len(found)
                    items += [batch.column("item")[at + k].as_py()] * len(found)
                at += len(offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(grams, pa.binary()), pa.array(sizes, pa.int32())],
                ["item", "gram", "size"])
    return run


class GramSet:
    """Window hashes by window size, with a bit table in front, and the grams' items."""

    def __init__(self, rows: list) -> None:
        self.items: dict[bytes, list[str]] = defaultdict(list)
        by_size: dict[int, set[bytes]] = defaultdict(set)
        for item, gram, size in rows:
            self.items[bytes(gram)].append(item)
            by_size[size].add(bytes(gram))
        self.sizes = {}
        for size, grams in by_size.items():
            hashes = np.unique([gram_hashes(*_one(g), size)[0] for g in grams])
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[hashes >> np.uint64(64 - _TABLE_BITS)] = True
            self.sizes[size] = (hashes, table)


def _one(gram: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(gram, np.uint8)
    return (data, *word_bounds(data, np.array([0, len(data)]), WORD)[:2])


def gram_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    words = range_hashes(data, start, end)
    at = np.arange(len(words) - size + 1)
    return range_hashes(words, at, at + size)


def scan_texts(texts: pa.Array, grams: GramSet) -> pa.StructArray:
    """Per text: n_words, the hit word places, and the items whose windows occur."""
    n_words, hits, items = [], [], []
    for data, offsets in text_slices(texts):
        data = LOWER[data]
        start, end, first = word_bounds(data, offsets, WORD)
        k = len(offsets) - 1
        slice_hits: list[list[np.ndarray]] = [[] for _ in range(k)]
        slice_items: list[set[str]] = [set() for _ in range(k)]
        for size, (hashes, table) in grams.sizes.items():
            if len(start) < size:
                continue
            window = gram_hashes(data, start, end, size)
            maybe = np.flatnonzero(table[window >> np.uint64(64 - _TABLE_BITS)])
            if not len(maybe):
                continue
            slot = np.minimum(np.searchsorted(hashes, window[maybe]), len(hashes) - 1)
            maybe = maybe[hashes[slot] == window[maybe]]
            text = np.searchsorted(first, maybe, "right") - 1
            inside = maybe + size <= first[text + 1]
            for w, t in zip(maybe[inside].tolist(), text[inside].tolist(), strict=True):
                gram = b" ".join(data[s:e].tobytes() for s, e in zip(
                    start[w:w + size], end[w:w + size], strict=True))
                if gram in grams.items:  # word for word, not by hash alone
                    slice_hits[t].append(np.arange(w, w + size) - first[t])
                    slice_items[t].update(grams.items[gram])
        n_words.append(np.diff(first))
        hits += [np.unique(np.concatenate(h)) if h else np.zeros(0, np.int64) for h in slice_hits]
        items += [sorted(s) for s in slice_items]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
         lists(hits, pa.int32()), pa.array(items, pa.list_(pa.string()))],
        ["n_words", "hits", "items"])


def _scanner(known: Broadcast):
    @F.arrow_udf("struct<n_words:bigint,hits:array<int>,items:array<string>>")
    def scan(texts: pa.Array) -> pa.Array:
        return scan_texts(texts, known.value)
    return scan


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text", n: int = 13,
              max_grams: int = MAX_GRAMS,
              names: tuple[str, str, str] = ("n_words", "hits", "items")) -> DataFrame:
    """Every row of ``docs`` with its word count, the hit word places and the items found.

    A word is hit if any occurrence of a benchmark window covers it; a window is
    ``n`` consecutive words of an item, or all of a shorter one. Null or empty
    texts have no words and no hits; items that are null, without words or
    without an id add none; repeated rows are scanned alike; ``items`` are
    distinct and sorted as strings; input columns called like the new ones are
    replaced; with an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    docs = without(docs, *names)
    grams = (benchmark.select(col(item_col).cast("string").alias("item"),
                              col(item_text_col).cast("string").alias("text"))
             .where("item IS NOT NULL AND text IS NOT NULL"))
    # An item has at most one window per byte: a bound on the set without building it.
    bound = grams.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(bound / 2 / max_grams))
    text = col(text_col).cast("string")
    rows = grams.mapInArrow(_grams(n), "item string, gram binary, size int")
    scan, h1, h2 = fresh(docs, "__scan", "__h1", "__h2")
    if blocks == 1:
        known = spark.sparkContext.broadcast(GramSet(rows.collect()))
        found = docs.withColumn(scan, _scanner(known)(text))
        return found.select(*map(col, docs.columns), *[F.col(f"{scan}.{c}").alias(name) for c, name in zip(
            ("n_words", "hits", "items"), names, strict=True)])
    ensure_checkpoint_dir(spark)
    hashes = [F.xxhash64(text).alias(h1), F.xxhash64(F.lit(1), text).alias(h2)]
    passes = []
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item", "gram"), F.lit(blocks)) == b)
        known = spark.sparkContext.broadcast(GramSet(block.collect()))
        passes.append(docs.select(*hashes, _scanner(known)(text).alias("s"))
                      .where(F.size("s.hits") > 0).select(h1, h2, "s.hits", "s.items").checkpoint())
        known.destroy()
    hits, items = fresh(docs, "__hits", "__items")
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(name)
             for c, name in (("hits", hits), ("items", items))]
    found = reduce(DataFrame.unionByName, passes).groupBy(F.col(h1).alias(h1 + "r"), F.col(h2).alias(h2 + "r")).agg(*union)
    # Without grams the scan counts the words alone.
    counted = docs.select("*", *hashes, _scanner(spark.sparkContext.broadcast(GramSet([])))(text).alias(scan))
    joined = counted.join(found, (F.col(h1) == F.col(h1 + "r")) & (F.col(h2) == F.col(h2 + "r")), "left")
    return joined.select(*map(col, docs.columns), F.col(f"{scan}.n_words").alias(names[0]),
                         F.coalesce(hits, F.array().cast("array<int>")).alias(names[1]),
                         F.coalesce(items, F.array().cast("array<string>")).alias(names[2]))


def contaminated(n_words: F.Column, n_hit: F.Column) -> F.Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def cut_words(texts: pa.Array, hits: pa.Array) -> pa.Array:
    """The texts without their hit words; a run of hit words goes with what lies between them."""
    out = []
    place = hits.fill_null([]) if hits.null_count else hits
    at = 0
    for data, offsets in text_slices(texts):
        start, end, first = word_bounds(LOWER[data], offsets, WORD)
        for k in range(len(offsets) - 1):
            words = np.array(place[at + k].as_py(), np.int64) + first[k]
            keep = np.ones(len(data) + 1, np.int32)
            if len(words):
                runs = np.split(words, np.flatnonzero(np.diff(words) > 1) + 1)
                for run in runs:
                    keep[start[run[0]]:end[run[-1]]] = 0
            lo, hi = offsets[k], offsets[k + 1]
            out.append(data[lo:hi][keep[lo:hi] > 0].tobytes().decode())
        at += len(offsets) - 1
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with every
    run of hit words cut out of the texts; null texts stay null."""
    names = tuple(fresh(docs, "__n_words", "__hits", "__items"))
    found = find_hits(docs, benchmark, text_col, names=names, **options)
    n_hit = F.size(names[1])
    if remove == "documents":
        return found.where(~contaminated(F.col(names[0]), n_hit)).select(*map(col, docs.columns))
    cut = F.when(n_hit > 0, F.arrow_udf(cut_words, "string")(col(text_col).cast("string"), F.col(names[1]))).otherwise(col(text_col))
    return found.select(*[cut.alias(c) if c == text_col else col(c) for c in docs.columns])
