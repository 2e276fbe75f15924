"""Drop lines that other documents hold too.

Plan: the lines' normalised keys are exploded as 128-bit hashes, distinct
(key, document) pairs are counted per key (both aggregates combine map-side, so
a line of a third of all documents costs one partial row per task), the keys at
or over the threshold are joined back to the thin (document, position) rows,
(the keys of very many documents in salted parts), and only the positions to
drop are joined to the texts. Texts cross the network
once; lines never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiercraft.llm.text import SPACE, col, fresh, lower_ascii, whole, without
from tiercraft.operators.skew import join_hot


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 10, min_docs: int = 2,
                n_lines_col: str = "n_lines", n_dropped_col: str = "n_dropped") -> DataFrame:
    """Every row of ``docs`` with its text freed of shared lines, plus the two counts.

    Texts are split at ``\\n``. A line's key is the line without surrounding
    white space, A-Z lower-cased. Keys of at least ``min_chars`` code points
    held by at least ``min_docs`` documents lose all their lines except in the
    smallest id holding them.

    Null or empty text: one empty line, kept, text ``""``. Null id: the row
    takes no part (its lines neither count nor fall). Rows that repeat an id are
    one document. Ties cannot occur (the smallest id keeps). Columns of any
    other name pass through; an input column called like a count column is
    replaced by it. An empty table gives an empty result.
    """
    docs = without(docs, n_lines_col, n_dropped_col)
    row_hash, drop, id2, hash2 = fresh(docs, "__row_hash", "__drop", "__id", "__hash")
    text = whole(col(text_col))
    lines = (docs.where(col(id_col).isNotNull())
             .select(col(id_col).alias("id"), F.xxhash64(text).alias("row_hash"),
                     F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
             .select("id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
             .where(F.length("key") >= min_chars)
             .select("id", "row_hash", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit(1), "key").alias("h2")))
    shared = (lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
              .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("id").alias("keeper"))
              .where(F.col("n_docs") >= min_docs))
    # A key of a thousandth of all documents is hot: there are at most a thousand
    # times as many of them as a document has lines.
    hot_from = max(1000, docs.count() // 1000)
    falls = (join_hot(lines, shared, ["h1", "h2"], "n_docs", F.col("id"), hot_from).where(F.col("id") != F.col("keeper"))
             .groupBy(F.col("id").alias(id2), F.col("row_hash").alias(hash2))
             .agg(F.collect_set("pos").alias(drop)))
    hashed = docs.withColumn(row_hash, F.xxhash64(text))
    joined = hashed.join(falls, (col(id_col) == F.col(id2))
                         & (F.col(row_hash) == F.col(hash2)), "left")
    parts = F.split(text, "\n", -1)
    n = F.size(parts)
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col(drop))
    new_text = F.when(F.col(drop).isNull(), text).otherwise(
        F.array_join(F.element_at(F.transform(F.array(parts), lambda p: F.transform(
            kept, lambda i: F.get(p, i))), 1), "\n"))
    return joined.select(
        *[new_text.alias(c) if c == text_col else col(c) for c in docs.columns],
        n.cast("long").alias(n_lines_col),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(n_dropped_col))
