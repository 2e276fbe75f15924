"""CSV files with line breaks in quoted cells, read by many tasks per file.

A reader that meets a split's first line cannot know whether it starts a record
or goes on inside a quoted cell. It can know what the line does to either state:
a line is a function from (outside, inside) to (outside, inside), and functions
compose. So the file is read as plain lines, and

1. each split is reduced to its composed function and the places of its first
   and last record starts under either state (one row per split);
2. the functions of a file's splits are applied from its start on: that gives
   the state at each split's first line. It happens on the driver, which holds
   one row of numbers per split, as it does to schedule them;
3. each task joins the lines of its records; only the lines of records that
   cross a border between splits are shuffled, and joined by record;
4. ``from_csv`` parses whole records.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiercraft.config import CSV_NA_TOKENS
from tiercraft.sources.readers import ROW_ORDER, _null_tokens

# A cell is empty, quoted (a doubled quote is one quote) or starts with another character;
# a quote inside a cell that does not start with one is only a character.
_QUOTED = r'(?:[^"]++|"")*+'
_CELLS = rf'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+)?+,)*+'
_OPENS = rf'\A{_CELLS}"{_QUOTED}\z'
_STAYS = rf'\A{_QUOTED}(?:\z|"[^,]*+,{_CELLS}"{_QUOTED}\z)'

_SUMMARY = ("file long, block long, first long, out_to_in boolean, in_to_in boolean, last_out long, last_in long, "
            "closes long, head string")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in place, each with what it does to the two states."""
    value = F.regexp_replace("value", r"\r\z", "")
    rows = (spark.read.text(path, lineSep="\n")
            .select(value.alias("value"), F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("pos")))

    def inside_after(pattern: str, unquoted: bool) -> Column:
        return F.when(F.instr("value", '"') == 0, unquoted).otherwise(F.regexp_like("value", F.lit(pattern)))
    return rows.select("value", "path", F.xxhash64("path").alias("file"), "block", "pos",
                       inside_after(_OPENS, False).alias("from_out"), inside_after(_STAYS, True).alias("from_in"))


def _states(from_out: np.ndarray, from_in: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line ends inside a quoted cell, if the first one starts so."""
    place = np.arange(len(from_out))
    fixed = np.maximum.accumulate(np.where(from_out == from_in, place, -1))   # last line that forgets the state
    swaps = np.concatenate([[0], np.cumsum(from_out & ~from_in)])
    known = np.where(fixed >= 0, from_out[fixed], start)
    return known ^ ((swaps[place + 1] - swaps[fixed + 1]) % 2 == 1)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The lines of one split after the other, at most a batch at a time."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        file, block = (table[c].to_numpy() for c in ("file", "block"))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, table.num_rows], strict=True):
            yield table.slice(a, b - a)


def _bools(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(bool)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its composed function, the last record start under each state (-1: none),
    the line that closes a cell open at its start (-1: none), and a file's first record."""
    now, first, state, last, closes, head, head_done = None, -1, [False, True], [-1, -1], -1, [], False

    def row():
        text = "\n".join(head) if head else None
        return pa.RecordBatch.from_pydict(
            {"file": [now[0]], "block": [now[1]], "first": [first], "out_to_in": [state[0]], "in_to_in": [state[1]],
             "last_out": [last[0]], "last_in": [last[1]], "closes": [closes], "head": [text]},
            pa.schema([("file", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("out_to_in", pa.bool_()), ("in_to_in", pa.bool_()),
                       ("last_out", pa.int64()), ("last_in", pa.int64()), ("closes", pa.int64()),
                       ("head", pa.string())]))
    for part in _splits(batches):
        key = (part["file"][0].as_py(), part["block"][0].as_py())
        if key != now:
            if now is not None:
                yield row()
            now, first = key, part["pos"][0].as_py()
            state, last, closes, head, head_done = [False, True], [-1, -1], -1, [], False
        to, pos = (_bools(part["from_out"]), _bools(part["from_in"])), part["pos"].to_numpy()
        for s in (0, 1):
            after = _states(*to, state[s])
            before = np.concatenate([[state[s]], after[:-1]])
            starts = np.flatnonzero(~before)
            if len(starts):
                last[s] = int(pos[starts[-1]])
            if s == 1 and closes < 0 and not after.all():
                closes = int(pos[np.flatnonzero(~after)[0]])
            if s == 0 and key[1] == 0 and not head_done:
                upto = np.flatnonzero(~after)
                head += part["value"].slice(0, int(upto[0]) + 1 if len(upto) else len(after)).to_pylist()
                head_done = bool(len(upto))
            state[s] = bool(after[-1])
    if now is not None:
        yield row()


def _starts(splits: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Splits by (file, block); whether each starts inside; the stretches of lines (file, block,
    from, to, record block, record pos) of records that cross a border."""
    order = np.lexsort((splits["block"], splits["file"]))
    inside = np.zeros(len(order), bool)
    pieces, state, record, file = [], False, None, None
    big = np.iinfo(np.int64).max
    for k in order:
        if splits["file"][k] != file:
            file, state, record = splits["file"][k], False, None
        here = (int(file), int(splits["block"][k]))
        inside[k] = state
        closes = int(splits["closes"][k])
        if state:
            pieces.append((*here, 0, closes if closes >= 0 else big, *record))
        last = int(splits["last_in" if state else "last_out"][k])
        state = bool(splits["in_to_in" if state else "out_to_in"][k])
        if state and last >= 0:         # the split's last record goes on after it
            record = (here[1], last)
            pieces.append((*here, last, big, *record))
    headers = set(zip(splits["file"].tolist(), splits["block"].tolist(), splits["first"].tolist(), strict=True))
    pieces = [p for p in pieces if p[4] or (p[0], 0, p[5]) not in headers]
    return order, inside, pieces


def _join_lines(starts_inside: frozenset[tuple[int, int]]):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that lie within one split; the rest of a batch's last record is held back."""
        now, state, held, started, header = None, False, [], None, -1
        for part in _splits(batches):
            key = (part["file"][0].as_py(), part["block"][0].as_py())
            if key != now:
                now, state, held, started = key, key in starts_inside, [], None
                header = -1 if key[1] else part["pos"][0].as_py()   # a file's first record is its header
            after = _states(_bools(part["from_out"]), _bools(part["from_in"]), state)
            before = np.concatenate([[state], after[:-1]])
            pos, value, path = part["pos"].to_numpy(), part["value"], part["path"][0].as_py()
            single = ~before & ~after & (pos != header)
            many_pos, many_text = [], []
            for i in np.flatnonzero(before | after):
                if not before[i]:
                    held, started = [], int(pos[i])
                if started is not None:     # else the record began in an earlier split
                    held.append(value[int(i)].as_py())
                    if not after[i] and started != header:
                        many_pos.append(started)
                        many_text.append("\n".join(held))
                    if not after[i]:
                        held, started = [], None
            state = bool(after[-1])
            texts = value.filter(pa.array(single)).to_pylist() + many_text
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(texts), pa.string()), pa.array([key[1]] * len(texts), pa.int64()),
                 pa.array(np.concatenate([pos[single], np.array(many_pos, np.int64)])), pa.array(texts, pa.string())],
                ["file", "block", "pos", "value"])
    return join


def read_split_csv(spark: SparkSession, path: str | list[str], na_tokens=CSV_NA_TOKENS) -> DataFrame:
    """CSV with a header, as :func:`tiercraft.sources.readers.read_records` reads it, but files are
    split (``spark.sql.files.maxPartitionBytes``) even where quoted cells hold line breaks.

    Lines end with ``\\n`` or ``\\r\\n``; a ``\\r\\n`` inside a cell reads as ``\\n``. Empty lines
    are no records, short records end in nulls, a quote that is never closed makes the
    rest of its file one record. All files must have the same header text.
    """
    lines = _lines(spark, path)
    rows = lines.drop("path").mapInArrow(_summarise, _SUMMARY).toArrow()
    heads = set(rows["head"].drop_null().to_pylist())
    if len(heads) != 1:
        raise ValueError(f"the files need one common header; found {sorted(heads)[:3]}")
    head = heads.pop()
    names = next(csv.reader([head]))
    splits = {c: rows[c].to_numpy() for c in rows.column_names if c != "head"}
    _, inside, pieces = _starts(splits)
    # At most one pair of numbers per split: the bytes of the files bound it.
    open_at = frozenset(zip(splits["file"][inside].tolist(), splits["block"][inside].tolist(), strict=True))
    records = lines.mapInArrow(_join_lines(open_at), "file string, block long, pos long, value string")
    if pieces:
        piece = spark.createDataFrame(pieces, "file long, block long, lo long, hi long, rec_block long, rec_pos long")
        crossing = (lines.drop("from_out", "from_in").join(F.broadcast(piece), ["file", "block"])  # two rows a split at most
                    .where(F.col("pos").between(F.col("lo"), F.col("hi")))
                    .groupBy("path", "rec_block", "rec_pos")
                    .agg(F.array_sort(F.collect_list(F.struct("block", "pos", "value"))).alias("parts")))
        records = records.unionByName(crossing.select(
            F.col("path").alias("file"), F.col("rec_block").alias("block"), F.col("rec_pos").alias("pos"),
            F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
    ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    cells = F.from_csv("value", ddl, {"quote": '"', "escape": '"'})
    kept = records.where("value <> ''")
    return _null_tokens(kept.select(cells.alias("c"), F.struct("file", "block", "pos").alias(ROW_ORDER))
                        .select("c.*", ROW_ORDER), na_tokens)
