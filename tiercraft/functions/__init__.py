"""Column expressions (pure ``Column -> Column`` builders, all JVM-side)."""

from tiercraft.functions.numbers import (fmt_int, fmt_money, fmt_pct, fmt_pct_signed,
                                         fmt_fixed, money_value, nan_to_null, parse_money,
                                         parse_strict, round_half_even)
from tiercraft.functions.text import (consent_standardise, flag_missing, id_is_missing,
                                      normalise_id, record_label, strip_ws, py_str)
from tiercraft.functions.dates import days_since, parse_date

__all__ = [
    "parse_money", "money_value", "parse_strict", "nan_to_null", "round_half_even",
    "fmt_money", "fmt_pct", "fmt_pct_signed", "fmt_fixed", "fmt_int",
    "consent_standardise", "flag_missing", "id_is_missing", "normalise_id",
    "record_label", "strip_ws", "py_str", "days_since", "parse_date",
]
