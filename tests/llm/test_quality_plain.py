"""The classifier's whole score against plain Python, and the bounds of its training sample."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tiercraft.llm import quality_crf as crf
from tiercraft.llm.quality_rules import COMMON_WORDS

TEXTS = [
    "The house is the house.\nthe the end\n\nBUY NOW!!! $$$ 100%\nThe house is the house.",
    "", "\n", None, "the", "the the", "end.", "\n\n  \t\nx", "Äußerst schöne Straße — über Öl.\nÄußerst",
    "a" * 500 + " " + "b1b2 " * 40, "no final break\n", "¿Dónde está?\r\nel perro, el gato; el perro",
    "the end\nof the", "of the\nthe of", "9 9 9\n9 9 9\n#tag_#tag", "日本語のテキスト\nAAA aaa Aaa",
]
_COMMON = {w for ws in COMMON_WORDS.values() for w in ws}
_CHARS = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789",
    "symbol": "#*$%&|<>=_{}[]\\/~^@", "shout": "!?", "mark": ".,;:'\"()-", "space": " \t\x0b\x0c\r",
}


def plain_features(text):
    """(features, length) per line, byte by byte."""
    out, last_word, seen = [], None, set()
    for line in (text or "").split("\n"):
        raw = line.encode()
        counts = {k: sum(raw.count(c.encode()) for c in chars) for k, chars in _CHARS.items()}
        words = [m for m in re.finditer(rb"[A-Za-z\x80-\xff]+", raw)]
        lows = [w.group().lower() if w.group().isascii() else
                bytes(b + 32 if 65 <= b <= 90 else b for b in w.group()) for w in words]
        again = 0
        for w in lows:
            again += w == last_word
            last_word = w
        common = sum(w in {c.encode() for c in _COMMON} for w in lows)
        capital = sum(65 <= w.group()[0] <= 90 for w in words)
        n, chars = len(words), max(len(raw), 1)
        letters, many = max(counts["upper"] + counts["lower"], 1), max(len(words), 1)
        repeated = float(raw in seen and n > 0)
        seen.add(raw)
        out.append(([
            math.log1p(len(raw)), math.log1p(n), counts["upper"] / letters, counts["digit"] / chars, counts["symbol"] / chars,
            counts["shout"] / chars, counts["mark"] / chars, counts["space"] / chars, (chars - sum(counts.values())) / chars,
            sum(map(len, lows)) / many / 10, again / many, common / many, capital / many, repeated,
            float(raw.endswith(b".")), float(n == 0)], chars))
    return out


def plain_score(model, text):
    """The length-weighted mean of the lines' marginals, the chain summed state by state."""
    rows = plain_features(text)
    zero = [0.0] * crf.N_FEATURES
    own = [r[0] for r in rows]
    unary = [float(np.dot(own[k] + (own[k - 1] if k else zero) + (own[k + 1] if k + 1 < len(own) else zero) + [1.0],
                          model.weights)) for k in range(len(own))]
    theta = model.theta
    ahead = [[1.0, math.exp(unary[0])]]
    for u in unary[1:]:
        a = ahead[-1]
        nxt = [sum(a[i] * math.exp(theta[i][j]) for i in (0, 1)) * math.exp(j * u) for j in (0, 1)]
        ahead.append([x / sum(nxt) for x in nxt])
    back = [[1.0, 1.0]]
    for u in reversed(unary[1:]):
        b = back[0]
        prev = [sum(math.exp(theta[i][j] + j * u) * b[j] for j in (0, 1)) for i in (0, 1)]
        back.insert(0, [x / sum(prev) for x in prev])
    good = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back, strict=True)]
    return sum(g * n for g, (_, n) in zip(good, rows, strict=True)) / sum(n for _, n in rows)


def test_features_byte_by_byte():
    joined = pa.array(TEXTS, pa.string())
    for data, offsets in crf.text_slices(joined):
        x, chars, first = crf.line_features(data, offsets)
        for k, t in enumerate(TEXTS):
            rows = plain_features(t)
            assert first[k + 1] - first[k] == len(rows), t
            assert np.allclose(x[first[k]:first[k + 1]], [r[0] for r in rows]), t
            assert chars[first[k]:first[k + 1]].tolist() == [r[1] for r in rows]


def test_whole_score_and_independence_of_the_batch():
    rnd = np.random.default_rng(4)
    for _ in range(5):
        model = crf.LineModel(rnd.normal(size=3 * crf.N_FEATURES + 1), rnd.normal(size=(2, 2)))
        together = model.score(pa.array(TEXTS, pa.string())).to_pylist()
        assert np.allclose(together, [plain_score(model, t) for t in TEXTS], atol=1e-9)
        alone = [model.score(pa.array([t], pa.string()))[0].as_py() for t in TEXTS]
        assert np.allclose(together, alone, atol=1e-12)


def _log_likelihood(x, first, y, w, theta, ridge):
    feats, total = crf.with_neighbours(x, first), 0.0
    for k in range(len(first) - 1):
        u = feats[first[k]:first[k + 1]] @ w
        alpha = np.array([0.0, u[0]])
        for v in u[1:]:
            alpha = np.logaddexp(alpha[0] + theta[0], alpha[1] + theta[1]) + np.array([0.0, v])
        gold = y[k] * u.sum() + (len(u) - 1) * theta[y[k], y[k]]
        total += gold - np.logaddexp(*alpha)
    return total / len(x) - ridge / 2 * (w @ w + (theta ** 2).sum())


def test_training_climbs_to_a_flat_point():
    """After many steps no small change of any parameter raises the likelihood it is meant to climb."""
    rnd = np.random.default_rng(7)
    first = np.array([0, 1, 4, 9, 11, 18, 20])
    y = np.array([0, 1, 1, 0, 1, 0])
    x = rnd.uniform(-1, 1, size=(20, crf.N_FEATURES)) + 0.5 * np.repeat(y, np.diff(first))[:, None]
    x[0], x[1] = 1.0, 1.0
    feats = crf.with_neighbours(x, first)
    scale = np.abs(feats).max(axis=0)
    model = crf.train(x, first, y, epochs=4000, rate=0.02, ridge=0.05)

    def value(scaled, theta):
        w = scaled / scale      # the ridge is on the scaled weights
        return _log_likelihood(x, first, y, w, theta, 0.0) - 0.025 * (scaled @ scaled + (theta ** 2).sum())
    scaled, theta, eps = model.weights * scale, model.theta, 1e-4
    for i in range(len(scaled)):
        d = np.zeros_like(scaled)
        d[i] = eps
        assert abs(value(scaled + d, theta) - value(scaled - d, theta)) / (2 * eps) < 2e-3
    for i in (0, 1):
        for j in (0, 1):
            d = np.zeros((2, 2))
            d[i, j] = eps
            assert abs(value(scaled, theta + d) - value(scaled, theta - d)) / (2 * eps) < 2e-3


@pytest.mark.parametrize(("max_lines", "max_text_lines", "used"), [(100, 100, 6), (100, 5, 5), (8, 5, 2), (0, 5, 0)])
def test_sample_is_bounded_in_lines(spark, monkeypatch, max_lines, max_text_lines, used):
    texts = ["word\n" * 3 + "end"] * 5 + ["w\n" * 30]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    seen = []
    monkeypatch.setattr(crf, "train", lambda x, first, y: seen.append(len(y)) or crf.LineModel(
        np.zeros(3 * crf.N_FEATURES + 1), np.zeros((2, 2))))
    crf.fit(docs, labels, held_out_fold=9, max_lines=max_lines, max_text_lines=max_text_lines)
    assert sum(seen) == used
