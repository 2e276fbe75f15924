"""Rows of the edge tests."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Extra columns named like columns that operators make or use inside.
EXTRA = ("id", "n", "Size", "kept", "Host", "line", "key", "pos", "spans", "hits", "score", "__salt", "__id",
         "__copies", "__size", "band", "component", "a.b", "row_hash", "source_size", "n_words")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                     StructField("lang", StringType()), StructField("source", StringType()),
                     StructField("n_chars", LongType())])
LONG = "lorem ipsum dolor " * 20_000 + "x" * 200_000
AWKWARD = [
    (1, "The first line of a document, long enough.\nShort\nA third line that is also long enough.", "en", "s1", 1),
    (2, None, "en", "s1", None), (3, "", None, None, 0), (4, " \t\n\x0b ", "fr", "s2", 4),
    (None, "The first line of a document, long enough.\nwithout an id", "en", "s1", 2),
    (1, "The first line of a document, long enough.\nShort\nA third line that is also long enough.", "en", "s1", 1),
    (5, "THE FIRST LINE OF A DOCUMENT, LONG ENOUGH.  \nother words follow here", "de", None, 5),
    (6, LONG, "en", "s2", len(LONG)), (7, LONG, "en", "s2", len(LONG)),
    (8, "mail a.b@example.org or 10.0.0.1, card 4111 1111 1111 1111, +1 (555) 123-4567 \U0001f600 é", "es", "s3", 9),
    (9, "one", "xx", "s3", 3),
]
