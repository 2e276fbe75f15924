"""Two tokenizers over one text: where their tokens end together, and which ids go together.

Per text, the byte offsets at which tokens end are two increasing arrays. They
are walked as a pair of places whose difference, the shift, says how many
tokens one side is ahead. As long as both sides cut alike, the shift holds:
exponential probing compares 1, 2, 4, ... ends of both arrays at once and jumps
whole one-to-one stretches. Where a comparison fails, the irregular group is
walked to its next common end, and the shift is updated.

Over the corpus, each pair of ids that end together is counted. One of the two
is always an ending of the other, so the two vocabularies alone bound the
pairs there can be: their table, some 320,000 rows, is known before any text is
read, each task counts into an array of that length, and the corpus counts can
be broadcast whatever the corpus holds.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercraft.llm.text import col, fresh, without
from tiercraft.llm.token_counts import _byte_symbols
from tiercraft.llm.vec import lists
from tiercraft.session import ensure_checkpoint_dir

BYTE_VOCAB, PIECE_VOCAB = "byte_bpe_50k.json", "piece_bpe_32k.model"
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: The byte-level tokenizer's own split (fixed).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in runs of about so many characters.
RUN_CHARS = 1 << 20


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` (int32, increasing, same last value) of the values both hold."""
    a, b = (np.ascontiguousarray(v, np.int32) for v in (a, b))
    raw_a, raw_b = a.tobytes(), b.tobytes()     # blocks are compared as memory
    at_a, at_b = memoryview(a), memoryview(b)
    number = int.from_bytes
    runs: list[int] = []                        # first place in a, first place in b, length
    i, j, n = 0, 0, len(a)
    while i < n:
        # Probe: 16, 32, 64, ... ends at this shift, as long as they agree.
        start, step = i, 64
        block_a, block_b = raw_a[4 * i:4 * i + step], raw_b[4 * j:4 * j + step]
        while block_a == block_b:
            i += len(block_a) >> 2
            j += len(block_a) >> 2
            if i >= n:
                break
            step *= 2
            block_a, block_b = raw_a[4 * i:4 * i + step], raw_b[4 * j:4 * j + step]
        else:   # the lowest bit that differs lies in the first end that differs
            differ = number(block_a, "little") ^ number(block_b, "little")
            same = (differ & -differ).bit_length() - 1 >> 5
            i += same
            j += same
        if i > start:
            runs += (start, j - i + start, i - start)
        if i >= n:
            break
        # An irregular group: walk both sides to their next common end, which sets the new shift.
        x, y = at_a[i], at_b[j]
        while x != y:
            if x < y:
                i += 1
                x = at_a[i]
            else:
                j += 1
                y = at_b[j]
        runs += (i, j, 1)
        i += 1
        j += 1
    first_a, first_b, size = np.array(runs, np.int64).reshape(-1, 3).T
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(first_a, size) + inside, np.repeat(first_b, size) + inside


class Aligner:
    """Both tokenizers, the bytes of their tokens and the table of pairs that can end together."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of_symbol = {c: i for i, c in enumerate(_byte_symbols())}
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        entries = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = bytes(map(of_symbol.__getitem__, token))
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            code = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.bytes_b.append(bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode())
        self.len_a, self.len_b = (np.array([len(t) for t in ts], np.int64) for ts in (self.bytes_a, self.bytes_b))
        # Every entry is what the merges make of its bytes, and ids follow the merges' order; so
        # merging by id gives the tokens of the file's own library, three times as fast.
        special = {t["id"] for t in spec["added_tokens"]}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, special_tokens={}, mergeable_ranks={
            t: i for i, t in enumerate(self.bytes_a) if i not in special})
        self.pairs = self._pairs()
        # An id and the mark after it as eight bytes, filled up with NUL: rows 2 * id and 2 * id + 1.
        marked = [f"{i}{mark}" for t, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;"))
                  for i in range(len(t)) for mark in marks]
        self.marked = np.array(marked, "S8").view(np.uint64)

    def _pairs(self) -> np.ndarray:
        """Sorted keys (b id, a id) of all pairs of which one is an ending of the other."""
        where_a, where_b = {}, {}
        for tokens, where in ((self.bytes_a, where_a), (self.bytes_b, where_b)):
            for i, t in enumerate(tokens):
                where.setdefault(t, []).append(i)
        keys = {self.key(a, b) for t, ids in where_a.items() for k in range(len(t))
                for b in where_b.get(t[k:], ()) for a in ids}
        keys |= {self.key(a, b) for t, ids in where_b.items() for k in range(1, len(t))
                 for a in where_a.get(t[k:], ()) for b in ids}
        return np.array(sorted(keys), np.int64)

    @staticmethod
    def key(a, b):
        return b * (1 << 20) + a

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of non-empty texts by both tokenizers; None if the tokens of either do not spell the text."""
        for text, ids_b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            spaced = " " + text
            # A's split and its 256 byte entries leave nothing of a text out, so A always spells it.
            spelt = b"".join(map(self.bytes_b.__getitem__, ids_b)) == spaced.encode()
            yield (np.array(self.a.encode_ordinary(spaced), np.int32), np.array(ids_b, np.int32)) if spelt else None

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last tokens of each group, in ``a`` and in ``b``."""
        return common_ends(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))

    def written(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> bytes:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        code_a, code_b = a.astype(np.int64) * 2, (b.astype(np.int64) + len(self.bytes_a)) * 2
        code_a[at_a] += 1
        code_b[at_b] += 1
        out = np.empty(len(a) + len(b), np.int64)
        # A group's A ids come before its B ids: each side is moved by what the other has put down.
        out[np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = code_a
        out[np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)] = code_b
        return self.marked[out].tobytes().translate(None, b"\0")[:-1]


@functools.lru_cache(maxsize=1)
def aligner(byte_vocab: str = BYTE_VOCAB, piece_vocab: str = PIECE_VOCAB) -> Aligner:
    import public_tokenizers

    return Aligner(public_tokenizers.path(byte_vocab), public_tokenizers.path(piece_vocab))


def _encoded(texts: pa.Array, al: Aligner) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """One entry per text, encoded in runs of bounded size."""
    run, size = [], 0
    for value in chain(texts, [None]):
        text = value.as_py() if value is not None else None
        if run and (value is None or size + len(text or "") > RUN_CHARS):
            encoded = al.encode([t for t in run if t])
            for t in run:
                yield next(encoded) if t else None
            run, size = [], 0
        run.append(text)
        size += len(text or "")


def align_texts(texts: pa.Array, al: Aligner) -> pa.Array:
    """Counts, digest and links of each text; ``pairs`` are places in the pair table, ascending, as
    differences, and ``times`` how often each is linked."""
    n_a, n_b, n_groups, digest, pairs, times = [], [], [], [], [], []
    none = np.zeros(0, np.int64)
    for ids in _encoded(texts, al):
        if ids is None:
            for out, v in ((n_a, 0), (n_b, 0), (n_groups, 0), (digest, ""), (pairs, none), (times, none)):
                out.append(v)
            continue
        a, b = ids
        at_a, at_b = al.groups(a, b)
        linked, often = np.unique(al.key(a[at_a].astype(np.int64), b[at_b].astype(np.int64)), return_counts=True)
        n_a.append(len(a))
        n_b.append(len(b))
        n_groups.append(len(at_a))
        digest.append(hashlib.sha256(al.written(a, b, at_a, at_b)).hexdigest())
        pairs.append(np.diff(np.searchsorted(al.pairs, linked), prepend=0))
        times.append(often)
    return pa.StructArray.from_arrays(
        [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()),
         pa.array(digest, pa.string()), lists(pairs, pa.int32()), lists(times, pa.int32())],
        ["n_a", "n_b", "n_groups", "digest", "pairs", "times"])


_ALIGNED = "struct<n_a:bigint,n_b:bigint,n_groups:bigint,digest:string,pairs:array<int>,times:array<int>>"


def _flat(pairs: pa.ListArray, times: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair places and times of all rows in a row, and the rows' borders."""
    sizes = pairs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    border = np.concatenate([[0], np.cumsum(sizes)])
    steps = pairs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(steps)
    before = np.concatenate([[0], total])[border[:-1]]
    return total - np.repeat(before, sizes), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64), border


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pair of a task: the array has the length of the pair table, whatever the task holds."""
    counts = np.zeros(len(aligner().pairs), np.int64)
    for batch in batches:
        place, times, _ = _flat(batch.column(0), batch.column(1))
        np.add.at(counts, place, times)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], ["pair", "n"])


def align(docs: DataFrame, text_col: str = "text", names: tuple[str, ...] = NAMES) -> DataFrame:
    """Every row of ``docs``, its text left out, with how the tokens of A and B align.

    A encodes a space and the text, B the text (it adds the space). ``n_a``,
    ``n_b``: tokens; ``n_groups``: stretches between common ends; ``n_links``:
    pairs of tokens that end together, one per group; ``count_sum``: corpus-wide
    counts of the links' id pairs, summed; ``n_best``: links whose count is the
    highest of their B id, ties included; ``groups_sha256``: digest of the groups
    written as ``a1,a2|b1;a3|b2,b3``. Texts that are null, empty or not spelt by
    the tokens of A and B have zeros and '' and no links. Rows that repeat count
    each; input columns called like the new ones are replaced; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    docs = without(docs, *names)
    keep = [c for c in docs.columns if c.lower() != text_col.lower()]
    (got,) = fresh(docs, "__aligned")
    run = F.arrow_udf(lambda texts: align_texts(texts, aligner()), _ALIGNED)
    (docs.select(*map(col, keep), run(col(text_col).cast("string")).alias(got))
     .write.option("compression", "zstd").parquet(folder))  # each text is encoded once
    rows = spark.read.parquet(folder)
    links = rows.where(F.col(f"{got}.n_groups") > 0).select(f"{got}.pairs", f"{got}.times")
    # At most one row per entry of the pair table, whose length the vocabularies bound.
    total = (links.mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
             .toArrow())
    al = aligner()
    counts = np.zeros(len(al.pairs), np.int64)
    counts[total["pair"].to_numpy()] = total["n"].to_numpy()
    piece = al.pairs >> 20
    highest = np.zeros(int(piece[-1]) + 1, np.int64)
    np.maximum.at(highest, piece, counts)
    known = spark.sparkContext.broadcast((counts, counts == highest[piece]))

    @F.arrow_udf("struct<best:bigint,total:bigint>")
    def read_off(pairs: pa.Array, times: pa.Array) -> pa.Array:
        count, best = known.value
        place, often, border = _flat(pairs, times)
        sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[border]) for v in (often * best[place], often * count[place])]
        return pa.StructArray.from_arrays([pa.array(s, pa.int64()) for s in sums], ["best", "total"])

    (score,) = fresh(rows, "__score")
    scored = rows.withColumn(score, read_off(F.col(f"{got}.pairs"), F.col(f"{got}.times")))
    columns = [f"{got}.n_a", f"{got}.n_b", f"{got}.n_groups", f"{got}.n_groups", f"{score}.best", f"{score}.total",
               f"{got}.digest"]
    return scored.select(*map(col, keep), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
