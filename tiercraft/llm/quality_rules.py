"""Quality rules: fixed limits, and divergence from language references.

A document's character classes and common words are counted as histograms and
compared, by Jensen-Shannon distance, with those of its language, which are
gathered from the whole corpus. Texts too short to tell are not compared.
Everything is column expressions; texts are read once, only the counts are
checkpointed, and the references are one small row per language: of listed
languages literals, of others (whose number has no bound) a joined table.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercraft.llm.text import SPACE, SPACE_CLASS, col, let, whole, words
from tiercraft.operators.skew import join_hot
from tiercraft.session import ensure_checkpoint_dir

#: Common words whose frequencies make up the word histogram (the rest is one bin).
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf",
           "ist", "im", "dem", "nicht", "ein", "eine"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with",
           "be", "as", "by", "this", "are"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por",
           "con", "no", "una", "su", "es"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour",
           "qui", "dans", "par", "au", "sur"),
}
CHAR_CLASSES = ("upper", "lower", "digit", "mark", "space", "other")
CHAR_PATTERNS = (r"[^\p{Lu}]+", r"[^\p{Ll}]+", r"[^0-9]+", r"[^.,;:!?'\"()-]+",
                 rf"[^{SPACE_CLASS}]+")
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Texts shorter than this are not compared.
MIN_CHARS, MIN_LETTER_WORDS = 200, 50
#: Distances above which a text is rejected. A histogram of n words strays from
#: its language by about 1 / sqrt(n), which is allowed on top.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.23
WINDOW = 3
#: Reference of texts without a language whose letters are of no listed script.
NO_LANG = ""


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    def places(keys: Column) -> Column:
        ordered = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(
                F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(
                F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))),
            lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        return let(F.array_sort(p), lambda s: F.aggregate(
            F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1), x + WINDOW) - x)),
            F.lit(0), lambda a, x: a + x))

    def count(a: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(a) - WINDOW), lambda i: F.xxhash64(
            *[F.get(a, i + k) for k in range(WINDOW)]))
        return let(keys, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0)
                   .otherwise(covered(places(h))))
    return let(w, lambda a: F.when(F.size(a) < WINDOW + 1, 0).otherwise(count(a))).cast("long")


def _char_counts(t: Column) -> Column:
    counts = [F.length(F.regexp_replace(t, p, "")) for p in CHAR_PATTERNS]
    return let(F.array(*counts), lambda c: F.concat(c, F.array(
        F.length(t) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))


def _letter_words(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), r"[^\p{L}]+", -1), lambda w: w != "")


def _listed_counts(w: Column, listed: Column) -> Column:
    """Occurrences of each listed word, then of all other letter words; null without a list."""
    hits = F.transform(listed, lambda word: F.size(w) - F.size(F.array_remove(w, word)))
    return let(hits, lambda h: F.concat(h, F.array(
        F.size(w) - F.aggregate(h, F.lit(0), lambda a, x: a + x))))


def _word_counts(t: Column, lang: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """``_listed_counts`` for the list of the language; empty for a language without one."""
    table = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    counts = let(_letter_words(t), lambda w: _listed_counts(w, F.element_at(table, lang)))
    return F.coalesce(counts, F.array().cast("array<int>"))


def _reference(lang: Column, t: Column, lists: Mapping[str, Sequence[str]]) -> Column:
    """The language to compare with; null (to be found) for a text without one in a listed script."""
    latin = all(unicodedata.name(x, "").startswith("LATIN") for v in lists.values() for w in v for x in w)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    other = F.length(F.regexp_replace(t, r"[^\p{L}]+|\p{IsLatin}+", ""))
    foreign = F.when(other * 2 > letters, F.lit(NO_LANG)) if latin else F.lit(None).cast("string")
    return F.when(F.btrim(lang, F.lit(SPACE)) != "", lang).otherwise(foreign)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            common_words: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """Per row: id, language of reference, the base counts and the two histograms.

    Where that language is null, ``guesses`` has the word histogram of each list, in order.
    """
    t = F.col("t")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE_CLASS}]")))
    guesses = let(_letter_words(t), lambda w: F.array(*[
        _listed_counts(w, F.array(*map(F.lit, v))) for v in common_words.values()]))
    return (docs.select(col(id_col).alias(id_col), col(lang_col).cast("string").alias("lang"),
                        whole(col(text_col)).alias("t"))
            .select(id_col, _reference(F.col("lang"), t, common_words).alias("reference"), "t",
                    let(words(t), lambda w: F.struct(
                        F.size(w).cast("long").alias("n_words"),
                        repeated_words(w).alias("n_repeat_words"))).alias("w"))
            .select(id_col, "reference", "w.n_words",
                    F.length(F.regexp_replace(t, f"[{SPACE_CLASS}]+", "")).cast("long").alias("word_chars"),
                    F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                    let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                    "w.n_repeat_words", _char_counts(t).alias("chars"),
                    _word_counts(t, F.col("reference"), common_words).alias("common"),
                    F.when(F.col("reference").isNull(), guesses).alias("guesses")))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of counts; 0 for an empty one."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def shares(c: Column) -> Column:
        return let(total(c), lambda n: F.transform(c, lambda x: x / n))

    def half(p: Column, q: Column) -> Column:
        return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log(x * 2 / (x + y)))
                                .otherwise(0.0)))
    distance = let(shares(counts), lambda p: let(shares(reference), lambda q: F.sqrt(
        F.greatest(F.lit(0.0), (half(p, q) + half(q, p)) / (2 * math.log(2))))))
    return F.when((total(counts) > 0) & (total(reference) > 0), distance).otherwise(0.0)


def _doubles(c: str) -> Column:
    return F.transform(F.col(c), lambda x: x.cast("double"))


def _nearest(measured: DataFrame, refs: Mapping[str, Mapping], lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """``measured`` with the nearest reference, and its word histogram, where there is none yet."""
    def literal(counts: Sequence[int]) -> Column:
        return F.array(*[F.lit(float(v)) for v in counts])

    def guess(k: int, lang: str) -> Column:
        counts = F.get("guesses", F.lit(k))
        return F.struct(
            js_distance(F.transform(counts, lambda x: x.cast("double")), literal(refs[lang]["common"])).alias("word"),
            js_distance(_doubles("chars"), literal(refs[lang]["chars"])).alias("char"),
            F.lit(lang).alias("lang"), counts.alias("counts"))
    guesses = [guess(k, lang) for k, lang in enumerate(lists) if lang in refs and sum(refs[lang]["common"])]
    if not guesses:
        return measured
    near = F.when(F.col("reference").isNull(), F.array_min(F.array(*guesses)))
    return (measured.withColumn("near", near)
            .withColumn("common", F.coalesce("near.counts", "common"))
            .withColumn("reference", F.coalesce("reference", "near.lang")).drop("near"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          common_words: Mapping[str, Sequence[str]] = COMMON_WORDS,
          max_char_distance: float = MAX_CHAR_DISTANCE,
          max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Per row of ``docs``: id, base counts, the two distances, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated
    3-word windows. ``kept``: not that, and both distances below their limits;
    character distances count from ``MIN_CHARS`` characters, word distances
    from ``MIN_LETTER_WORDS`` words on. An unlisted language has a character
    reference of its own from the corpus and no word distance (0). A text with
    a null or blank language is compared with the nearest reference (by words,
    then characters) of the listed languages in the corpus; if most of its
    letters are of no listed script, texts like it are one unlisted language.
    Neither kind counts in the references of listed languages. Null and empty
    texts have no words and fail the base; repeated rows are judged alike (and
    counted in the references as often as they occur); extra columns do not
    matter; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    measured = measure(docs, id_col, text_col, lang_col, common_words).checkpoint()
    listed = F.coalesce(F.col("reference").isin(*common_words), F.lit(False))
    sizes = {"chars": len(CHAR_CLASSES), "common": 1 + max(map(len, common_words.values()))}

    def sums(c: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.get(c, F.lit(k)).cast("long")), F.lit(0)) for k in range(sizes[c])]).alias(c)
    # One row per listed language, and one for all other rows.
    found = measured.groupBy(F.when(listed, F.col("reference")).alias("of")).agg(
        *map(sums, sizes), F.count("*").alias("n"), F.count("reference").alias("n_named")).collect()
    refs = {r["of"]: r for r in found if r["of"] is not None}
    rest = next((r for r in found if r["of"] is None), None)
    n_own = rest["n_named"] if rest else 0
    if rest and rest["n"] > n_own:
        measured = _nearest(measured, refs, common_words)

    def reference(c: str) -> Column:
        rows = [x for k, r in refs.items() for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in r[c]]))]
        none = F.array().cast("array<double>")
        return F.coalesce(F.element_at(F.create_map(*rows), F.col("reference")), none) if rows else none

    def judged(rows: DataFrame, chars: Column, common: Column) -> DataFrame:
        return (rows.withColumn("char_distance", js_distance(_doubles("chars"), chars))
                .withColumn("word_distance", js_distance(_doubles("common"), common)))
    compared = judged(measured.where(listed | F.col("reference").isNull()) if n_own else measured,
                      reference("chars"), reference("common"))
    if n_own:
        own = measured.where(~listed & F.col("reference").isNotNull())
        own_refs = own.groupBy("reference").agg(sums("chars"), F.count("*").alias("n")).select(
            "reference", "n", _doubles("chars").alias("ref_chars"))
        paired = join_hot(own, own_refs, ["reference"], "n", F.struct(col(id_col), F.col("chars")),
                          max(1000, n_own // 1000))
        compared = compared.unionByName(judged(paired, F.col("ref_chars"), reference("common")).drop("ref_chars"))
    n_chars = F.aggregate("chars", F.lit(0), lambda a, x: a + x)
    n_letters = F.aggregate("common", F.lit(0), lambda a, x: a + x)
    far = (((n_chars >= MIN_CHARS) & (F.col("char_distance") > max_char_distance))
           | ((n_letters >= MIN_LETTER_WORDS) & (F.col("word_distance") > max_word_distance + 1 / F.sqrt(n_letters.cast("double")))))
    failed = ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return (compared.withColumn("base_failed", failed)
            .select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    F.round("char_distance", 6).alias("char_distance"),
                    F.round("word_distance", 6).alias("word_distance"),
                    "base_failed", (~F.col("base_failed") & ~far).alias("kept")))
