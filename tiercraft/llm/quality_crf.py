"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad given its own features and its neighbours'; the chain
couples neighbouring labels. Training lines carry their document's label. A
document's score is the mean of its lines' forward-backward marginals, weighted
by line length. The model is fitted on a sample of labelled documents that is bounded in
documents and in lines and whose line features (not texts) come to the driver;
scoring is one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercraft.llm.quality_rules import COMMON_WORDS
from tiercraft.llm.text import col, fresh, without
from tiercraft.llm.vec import LOWER, byte_class, range_hashes, text_slices, word_bounds
from tiercraft.session import ensure_checkpoint_dir

#: The sample: so many labelled documents, in the order of a hash of their id; of these, those of
#: at most MAX_TEXT_LINES lines, while they hold no more than MAX_TRAIN_LINES together.
MAX_TRAIN_DOCS, MAX_TRAIN_LINES, MAX_TEXT_LINES = 3000, 400_000, 5000
THRESHOLD = 0.7
EPOCHS, RATE, RIDGE = 150, 0.1, 1e-3

_CLASSES = {
    "upper": byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": byte_class("abcdefghijklmnopqrstuvwxyz"),
    "digit": byte_class("0123456789"),
    "symbol": byte_class("#*$%&|<>=_{}[]\\/~^@"),
    "shout": byte_class("!?"),
    "mark": byte_class(".,;:'\"()-"),
    "space": byte_class(" \t\x0b\x0c\r"),
}
_LETTER = byte_class("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_NOT_BREAK = byte_class("\n", inverse=True)


def _common() -> np.ndarray:
    data = " ".join(w for ws in COMMON_WORDS.values() for w in ws).encode()
    buf = np.frombuffer(data, np.uint8)
    return np.unique(range_hashes(buf, *word_bounds(buf, np.array([0, len(buf)]), _LETTER)[:2]))


_COMMON = _common()
N_FEATURES = 16


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of a slice's lines, and each text's first line (one entry more).

    A text has one line more than it has line breaks, so an empty text has one.
    """
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(offsets, breaks, "right") - 1
    per_text = np.bincount(text_of_break, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(per_text + 1)])
    start = np.empty(first[-1], np.int64)
    start[first[:-1]] = offsets[:-1]
    rank = np.arange(len(breaks)) - np.searchsorted(text_of_break, text_of_break) + 1
    start[first[text_of_break] + rank] = breaks + 1
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = offsets[1:]
    size = end - start
    low = LOWER[data]
    ws, we, first_word = word_bounds(low, offsets, _LETTER)
    word = range_hashes(low, ws, we)
    w0, w1 = np.searchsorted(ws, start), np.searchsorted(ws, end)
    n_words = w1 - w0

    def per_line(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[b] - total[a]).astype(np.float64)
    n = {k: per_line(table[data], start, end) for k, table in _CLASSES.items()}
    again = np.concatenate([[False], word[1:] == word[:-1]]) if len(word) else np.zeros(0, bool)
    again[first_word[:-1][first_word[:-1] < len(word)]] = False     # a text's first word repeats none
    common = _COMMON[np.minimum(np.searchsorted(_COMMON, word), len(_COMMON) - 1)] == word
    capital = _CLASSES["upper"][data[ws]]
    chars, letters = np.maximum(size, 1), np.maximum(n["upper"] + n["lower"], 1)
    many = np.maximum(n_words, 1)
    last = np.where(size > 0, data[np.maximum(end - 1, 0)] if len(data) else 0, 0)
    line_hash = range_hashes(data, start, end)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((np.arange(len(start)), line_hash, owner))
    same = (np.diff(owner[order], prepend=-1) == 0) & (line_hash[order] == np.roll(line_hash[order], 1))
    seen = np.zeros(len(start))
    seen[order] = same & (n_words[order] > 0)
    x = np.stack([
        np.log1p(size), np.log1p(n_words), n["upper"] / letters, n["digit"] / chars,
        n["symbol"] / chars, n["shout"] / chars, n["mark"] / chars, n["space"] / chars,
        (chars - sum(n.values())) / chars, per_line(we - ws, w0, w1) / many / 10,
        per_line(again, w0, w1) / many, per_line(common, w0, w1) / many,
        per_line(capital, w0, w1) / many, seen, last == ord("."), n_words == 0], axis=1)
    return x, chars.astype(np.float64), first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after (zeros at the text's ends), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def _step(odds: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Log odds of the next label given those of this one; ``theta[i, j]`` scores i then j."""
    return (np.logaddexp(theta[0, 1], theta[1, 1] + odds)
            - np.logaddexp(theta[0, 0], theta[1, 0] + odds))


def _padded(first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of like line counts: (texts, line index per text and step, whether there is one)."""
    count = np.diff(first)
    out = []
    group = np.ceil(np.log2(np.maximum(count, 1))).astype(int)
    for g in np.unique(group):
        texts = np.flatnonzero(group == g)
        steps = np.arange(count[texts].max())
        there = steps < count[texts][:, None]
        out.append((texts, np.where(there, first[texts][:, None] + steps, first[texts][:, None]), there))
    return out


def chain(unary: np.ndarray, there: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds (with the line's own) and backward log odds (without) of a padded group."""
    f, b = np.zeros_like(unary), np.zeros_like(unary)
    f[:, 0] = unary[:, 0]
    for t in range(1, unary.shape[1]):
        f[:, t] = unary[:, t] + _step(f[:, t - 1], theta)
    for t in range(unary.shape[1] - 2, -1, -1):
        b[:, t] = np.where(there[:, t + 1], _step(unary[:, t + 1] + b[:, t + 1], theta.T), 0)
    return f, b


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray
    theta: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        unary = with_neighbours(x, first) @ self.weights
        out = np.zeros(len(x))
        for _, lines, there in _padded(first):
            f, b = chain(unary[lines], there, self.theta)
            out[lines[there]] = 1 / (1 + np.exp(-np.clip(f + b, -40, 40)))[there]
        return out

    def score(self, texts: pa.Array) -> pa.Array:
        out = []
        for data, offsets in text_slices(texts):
            x, chars, first = line_features(data, offsets)
            good = self.marginals(x, first) * chars
            out.append(np.add.reduceat(good, first[:-1]) / np.add.reduceat(chars, first[:-1]))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())


def train(x: np.ndarray, first: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS,
          rate: float = RATE, ridge: float = RIDGE) -> LineModel:
    """Maximum conditional likelihood by Adam; every line carries its text's label."""
    feats = with_neighbours(x, first)
    scale = np.maximum(np.abs(feats).max(axis=0), 1e-9) if len(feats) else np.ones(feats.shape[1])
    feats = feats / scale
    y = np.repeat(labels, np.diff(first)).astype(np.float64)
    groups = _padded(first)
    param = np.zeros(feats.shape[1] + 4)
    m, v = np.zeros_like(param), np.zeros_like(param)
    n = max(1, len(feats))
    for k in range(1, epochs + 1):
        w, theta = param[:-4], param[-4:].reshape(2, 2)
        unary, p, d_theta = feats @ w, np.zeros(len(feats)), np.zeros((2, 2))
        for texts, lines, there in groups:
            u = unary[lines]
            f, b = chain(u, there, theta)
            p[lines[there]] = 1 / (1 + np.exp(-np.clip(f + b, -40, 40)))[there]
            if u.shape[1] > 1:
                pair = there[:, 1:]
                ahead = (u + b)[:, 1:]
                score = [[theta[i, j] + i * f[:, :-1] + j * ahead for j in (0, 1)] for i in (0, 1)]
                norm = np.logaddexp(np.logaddexp(*score[0]), np.logaddexp(*score[1]))
                label = labels[texts]
                for i in (0, 1):
                    for j in (0, 1):
                        seen = pair[label == i].sum() if i == j else 0
                        d_theta[i, j] += seen - np.exp(score[i][j] - norm)[pair].sum()
        grad = np.concatenate([feats.T @ (y - p), d_theta.ravel()]) / n - ridge * param
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        param = param + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return LineModel(param[:-4] / scale, param[-4:].reshape(2, 2))


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(col(id_col).cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", held_out_fold: int = 2,
        max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES,
        max_text_lines: int = MAX_TEXT_LINES) -> LineModel:
    """The model of at most ``max_docs`` labelled documents outside the held-out fold.

    Those of more than ``max_text_lines`` lines are left out, and those beyond the first
    ``max_lines`` lines of all; every text is scored, whatever its lines. Rows without a label or an id are left out; of an id's rows the one with the
    smallest text and label is taken; with no labels at all every text scores 0.5.
    """
    known = (labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold("id") != held_out_fold)))
    ids = docs.where(col(id_col).isNotNull()).select(col(id_col).alias("id")).distinct()
    sample = (known.groupBy("id").agg(F.min("label").alias("label")).join(ids, "id")
              .orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_docs))
    # The sample has max_docs rows at most, so it can be broadcast.
    texts = (docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
             .join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")))
    ensure_checkpoint_dir(docs.sparkSession)
    texts = texts.withColumn("lines", F.regexp_count("text", F.lit("\n")) + 1).checkpoint()    # read twice
    # A window over at most max_docs rows of two columns.
    running = Window.orderBy(F.md5(F.col("id").cast("string")), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = (texts.select("id", "lines").where(F.col("lines") <= max_text_lines)
             .withColumn("so_far", F.sum("lines").over(running)).where(F.col("so_far") <= max_lines).select("id"))
    texts = texts.join(F.broadcast(taken), "id")

    def features(t: pa.Array) -> pa.Array:
        out = []
        for data, offsets in text_slices(t):
            x, _, first = line_features(data, offsets)
            out += [x[a:b].astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.array(out, pa.binary())
    rows = texts.select("id", "label", F.arrow_udf(features, "binary")("text").alias("x")).collect()
    if not rows:
        return LineModel(np.zeros(3 * N_FEATURES + 1), np.zeros((2, 2)))
    rows.sort(key=lambda r: r["id"])
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return train(np.concatenate(parts).astype(np.float64), first, np.array([r["label"] for r in rows]))


def score_documents(docs: DataFrame, model: LineModel, text_col: str = "text",
                    score_col: str = "score") -> DataFrame:
    """Every row of ``docs`` with its score (0 to 1, higher: better).

    Null and empty texts are one empty line and get the model's score for that;
    repeated rows score alike; an input column of the name is replaced; empty
    tables stay empty. The whole text counts, whatever its length.
    """
    docs = without(docs, score_col)
    return docs.withColumn(score_col, F.arrow_udf(model.score, "double")(col(text_col).cast("string")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without those that score below the threshold."""
    (score,) = fresh(docs, "__score")
    model = fit(docs, labels, id_col, text_col, **options)
    return score_documents(docs, model, text_col, score).where(F.col(score) >= threshold).drop(score)
