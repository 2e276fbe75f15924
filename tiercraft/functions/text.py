"""Text / identity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FractionalType, StringType

from tiercraft.config import MISSING_ID_TOKENS
from tiercraft.functions.columns import ColumnOrName
from tiercraft.functions.columns import col as _col

# Every character Python's str.strip() removes (str.isspace), by rule.
PY_WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def strip_ws(c: ColumnOrName) -> Column:
    """Strip leading/trailing whitespace the way Python's str.strip() does
    (Spark's trim drops only spaces). A character-set trim, not a regex, and
    only for texts that do not start and end in plain ASCII marks already."""
    c = _col(c)
    plain = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(PY_WHITESPACE)))


def py_str(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    """Canonical text of a value: integral doubles lose '.0' so ids read as
    numbers match ids read as text."""
    c = _col(c)
    if isinstance(dtype, FractionalType):
        return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")) \
            .otherwise(c.cast("string"))
    if dtype is None or isinstance(dtype, StringType):
        return c.cast("string")
    return c.cast("string")


def normalise_id(c: ColumnOrName, dtype: DataType | None = None) -> Column:
    """Identity key: text, stripped."""
    return strip_ws(py_str(c, dtype))


def id_is_missing(c: ColumnOrName, dtype: DataType | None = None,
                  key: Column | None = None) -> Column:
    """NULL id, or an id whose stripped text is '', 'nan', 'None' or 'NaN'.
    ``key`` is the already normalised id when the caller has it."""
    raw = _col(c)
    key = normalise_id(raw, dtype) if key is None else key
    missing = raw.isNull() | key.isin(*MISSING_ID_TOKENS)
    if isinstance(dtype, FractionalType):
        missing = missing | F.isnan(raw)
    return missing


def consent_standardise(c: ColumnOrName) -> Column:
    """trim + lower; yes/no to Yes/No; everything else (NULL, 'y') Unknown."""
    norm = F.lower(strip_ws(_col(c).cast("string")))
    return (F.when(norm == "yes", F.lit("Yes"))
            .when(norm == "no", F.lit("No"))
            .otherwise(F.lit("Unknown")))


def flag_missing(c: ColumnOrName) -> Column:
    """NULL or exactly '' becomes 'MISSING'; whitespace-only cells are kept."""
    c = _col(c)
    text = c.cast("string")      # an integer column cannot hold the word
    return F.when(text.isNull() | (text == ""), F.lit("MISSING")).otherwise(text)


def flag_issue(c: ColumnOrName) -> Column:
    """Cells counted as missing in the clean report: NULL or blank after strip."""
    c = _col(c)
    return c.isNull() | (strip_ws(c.cast("string")) == "")


def record_label(name: ColumnOrName | None, id_col: ColumnOrName | None) -> Column:
    """'FullName (id)' when a name column exists, else the id; a missing name
    or id reads 'nan'."""
    if name is None:
        return shown(_col(id_col))
    return F.concat(shown(_col(name)), F.lit(" ("), shown(_col(id_col)), F.lit(")"))


def shown(c: ColumnOrName) -> Column:
    """Text of a cell in a sentence: a missing one reads 'nan'."""
    return F.coalesce(_col(c).cast("string"), F.lit("nan"))
