"""Column helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: blank, tab, \n, \v, \f, \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did.

    On a cluster the package is installed or sent with ``--py-files``; this
    covers a driver that only extended its own ``sys.path``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``df`` (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns of these names (case-insensitively, as Spark resolves them)."""
    gone = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in gone])


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once per row.

    A lambda that mentions an outer expression evaluates it again for each
    element; bound as a lambda variable it is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def whole(c: Column) -> Column:
    """A text with null as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def word_count(c: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.regexp_count(whole(c), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def words(c: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` of a text, in order; empty for null."""
    bare = F.btrim(whole(c), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, f"[{SPACE_CLASS}]+", -1))
