"""Number parsing, rounding and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tiercraft.config import MONEY_KEEP_PATTERN
from tiercraft.functions.columns import ColumnOrName
from tiercraft.functions.columns import col as _col


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN becomes NULL (Spark orders NaN above every number and sums to NaN)."""
    c = _col(c)
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def parse_money(c: ColumnOrName) -> Column:
    """Money text to double: keep only digits, '.' and '-', empty to NULL,
    anything still unreadable ('1.2.3', '1-2', '-') to NULL."""
    kept = F.regexp_replace(_col(c).cast("string"), MONEY_KEEP_PATTERN, "")
    return F.nullif(kept, F.lit("")).try_cast("double")


def money_value(df: DataFrame, name: str) -> Column:
    """Money value of column ``name``: numeric columns are cast directly (they
    never pass through text, which would mangle 1.2E7), text is parsed."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, NumericType):
        return nan_to_null(name)
    return parse_money(name)


# Strings a strict numeric parse accepts: optional sign, digits with an
# optional fraction, optional exponent, or inf / nan words; blanks around.
_STRICT_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def parse_strict(df: DataFrame, name: str) -> Column:
    """Strict numeric parse: '$5' and '1,000' are NULL, ' 5 ' and '1e5' parse."""
    dtype = df.schema[name].dataType
    c = _col(name)
    if isinstance(dtype, NumericType):
        return nan_to_null(c)
    s = c.cast("string")
    ok = F.lower(s).rlike(_STRICT_NUMBER)
    return nan_to_null(F.when(ok, F.trim(s).try_cast("double")))


def round_half_even(c: ColumnOrName, digits: int) -> Column:
    """Round the way numpy does: rint(x * 10^d) / 10^d (ties to even on the
    scaled binary value). Spark's round/bround differ on ties and scaling."""
    scale = float(10 ** digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def fmt_money(c: ColumnOrName, sym: str = "$") -> Column:
    """'{sym}{x:,.2f}'; a missing number renders as 'nan'."""
    return F.concat(F.lit(sym), F.coalesce(F.format_number(_col(c), 2), F.lit("nan")))


def fmt_fixed(c: ColumnOrName, digits: int) -> Column:
    """'{x:.Nf}' (no thousands separator); NULL renders as 'nan'."""
    return F.coalesce(F.regexp_replace(F.format_number(_col(c), digits), ",", ""),
                      F.lit("nan"))


def fmt_pct(c: ColumnOrName, digits: int = 0) -> Column:
    """'{x:.Nf}%'."""
    return F.concat(fmt_fixed(c, digits), F.lit("%"))


def fmt_pct_signed(c: ColumnOrName) -> Column:
    """'{x:+.0f}%': '+' unless the formatted number already carries '-'."""
    body = fmt_fixed(c, 0)
    signed = F.when(body.startswith("-") | (body == "nan"), body).otherwise(
        F.concat(F.lit("+"), body))
    return F.concat(signed, F.lit("%"))


def fmt_int(c: ColumnOrName, thousands: bool = False) -> Column:
    """int(x) as text, optionally with thousands separators ('{:,}')."""
    as_long = _col(c).cast("bigint")
    if thousands:
        return F.format_number(as_long, 0)
    return as_long.cast("string")
