"""Exact token counts at every prefix, by dynamic programming over a BPE vocabulary.

A sequence of BPE tokens is what the merges produce exactly if each
neighbouring pair is: merging the joined bytes of the two gives the two back.
So every prefix of a word has one last token that fits the prefix before it,
and ``count[i] = count[i - len(last)] + 1`` fills a table from left to right.
Words never merge across their borders, so a text's table is the running sum
over its words. Truncation points and budgets are read off the table; no text
is encoded twice.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiercraft.llm.text import col, fresh, without

VOCAB = "word_bpe_49k.json"
BUDGETS = (2048,)
_CACHED_WORDS, _CACHED_CHARS = 400_000, 64


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


_SYMBOL = _byte_symbols()
#: The vocabulary's word pattern, and the same for texts of Latin letters only
#: (below U+0250) in the plain ``re`` module, which is more than twice as fast.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATIN_WORD = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]+")


class _WordCounts(dict):
    """Tokens per word, filled on demand and of bounded size."""

    def __init__(self, counter: PrefixCounter) -> None:
        self.counter = counter

    def __missing__(self, word: str) -> int:
        counter = self.counter
        known = counter.table(word)[-1]
        if len(word) <= _CACHED_CHARS:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            if counter.n_fits >= 4 * _CACHED_WORDS:
                counter.fits.clear()
                counter.n_fits = 0
            self[word] = known
        return known


class PrefixCounter:
    """Prefix token tables for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: frozenset[str] = frozenset(model["vocab"])
        #: All endings of tokens: a stretch that is none starts no token.
        self.tails = frozenset(t[k:] for t in self.vocab for k in range(len(t)))
        self.rank = {(a, b): i for i, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.latin = _LATIN_WORD if split == _WORD else self.word
        self.fits: dict[str, dict[str, bool]] = defaultdict(dict)
        self.n_fits = 0
        self.words = _WordCounts(self)

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(symbols, symbols[1:])]
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _pair_fits(self, a: str, b: str) -> bool:
        """Whether the merges give back ``b`` after ``a`` (or alone, after nothing)."""
        if not a:
            return self._merged(self._symbols(b)) == [b]
        return self._merged(self._symbols(a) + self._symbols(b)) == [a, b]

    def table(self, word: str) -> list[int]:
        """Token counts of every prefix of a word's bytes; the last is the whole word's."""
        text = "".join([_SYMBOL[b] for b in word.encode()])
        n, vocab, tails = len(text), self.vocab, self.tails
        count, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            mark = self.end if i == n else ""
            found = []  # the places where a token that ends here can start, nearest first
            for j in range(i - 1, -1, -1):
                token = text[j:i] + mark
                if token not in tails:
                    break
                if token in vocab:
                    found.append((j, token))
            for j, token in reversed(found):
                after = self.fits[last[j]]
                fits = after.get(token)
                if fits is None:
                    fits = after[token] = self._pair_fits(last[j], token)
                    self.n_fits += 1
                if fits:
                    count[i], last[i] = count[j] + 1, token
                    break
        return count

    def split(self, text: str) -> list[str]:
        return (self.latin if text and max(text) < "\u0250" else self.word).findall(text)

    def normalise(self, text: str) -> str:
        """NFC and lower case. White space, which no word holds, is left as it is."""
        text = unicodedata.normalize("NFC", text)
        # Character by character: str.lower would give a final sigma its own form.
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens up to and including each word (or special string) of a text."""
        counts: list[int] = []
        at = 0
        for m in [*self.special.finditer(text), None]:
            piece = self.normalise(text[at:m.start()] if m else text[at:])
            counts += map(self.words.__getitem__, self.split(piece))
            if m:
                counts.append(1)
                at = m.end()
        return np.cumsum(np.array(counts, np.int64))


@functools.lru_cache(maxsize=2)
def counter(vocab: str) -> PrefixCounter:
    import public_tokenizers

    return PrefixCounter(public_tokenizers.path(vocab))


def count_tokens(docs: DataFrame, text_col: str = "text", vocab: str = VOCAB,
                 budgets: tuple[int, ...] = BUDGETS,
                 names: tuple[str, str] = ("n_tokens", "words_within")) -> DataFrame:
    """Every row of ``docs`` with ``n_tokens`` and ``words_within``.

    ``n_tokens`` equals what the tokenizers library encodes without begin, end
    or added special tokens; a special string inside a text is one token.
    ``words_within`` has, per budget, how many of the text's words fit into so
    many tokens. Null and empty texts have 0; repeated rows count alike; input
    columns called like the new ones are replaced; an empty table stays empty.
    """
    docs = without(docs, *names)
    (both,) = fresh(docs, "__counted")
    limits = np.array(budgets, np.int64)

    @F.arrow_udf("struct<n:bigint,within:array<bigint>>")
    def count(texts: pa.Array) -> pa.Array:
        c = counter(vocab)
        n, within = [], []
        for text in texts:
            table = c.prefix_counts(text.as_py() or "")
            n.append(int(table[-1]) if len(table) else 0)
            within.append(np.searchsorted(table, limits, "right").tolist())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(within, pa.list_(pa.int64()))], ["n", "within"])

    counted = docs.withColumn(both, count(col(text_col).cast("string")))
    return counted.select(*map(col, docs.columns), F.col(f"{both}.n").alias(names[0]),
                          F.col(f"{both}.within").alias(names[1]))
