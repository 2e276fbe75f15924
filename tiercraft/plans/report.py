"""The plain-text summary report as numbered lines.

The value table is laid out the way pandas prints a DataFrame
(``to_string``): numeric headers carry a leading space, integers are
``' d'``, floats ``' .6f'`` with trailing zeros trimmed equally down the
column (at least one decimal), switching to ``' .6e'`` for values that would
print as 0 or take too much room; columns are right-justified and joined by
one space, the index left-justified with its name on a row of its own. The
widths come from windows over the aggregated table (a handful of segments).
The recommendation section, written by an external service in the original
tool, is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOAT_DIGITS = 6


def _float_text(c: Column, every: Window) -> tuple[Column, Column]:
    """Formatted text of a float column (and its fixed-point form)."""
    # format_string renders NULL as the text "null": keep missing values NULL
    fixed6 = F.when(c.isNotNull(), F.format_string(f"% .{FLOAT_DIGITS}f", c))
    frac = F.substring_index(fixed6, ".", -1)
    needed = F.length(F.regexp_replace(frac, "0+$", ""))
    keep = F.greatest(F.lit(1), F.max(F.when(c.isNotNull(), needed)).over(every))
    fixed = F.substring(fixed6, F.lit(1), F.length(fixed6) - (F.lit(FLOAT_DIGITS) - keep))
    shown = F.coalesce(fixed, F.lit("NaN"))
    too_long = F.max(F.length(shown)).over(every) > FLOAT_DIGITS + 6
    large = F.max(F.abs(c) > 1e6).over(every)
    small = F.max((F.abs(c) < 10 ** -FLOAT_DIGITS) & (F.abs(c) > 0)).over(every)
    sci = F.coalesce(F.when(c.isNotNull(), F.format_string(f"% .{FLOAT_DIGITS}e", c)),
                     F.lit("NaN"))
    return F.when(F.coalesce(small, F.lit(False)) | (too_long & F.coalesce(large, F.lit(False))),
                  sci).otherwise(shown), fixed


def value_table_lines(vtable: DataFrame, first_line_no: int = 1) -> DataFrame:
    """The value table (Segment, Records, TotalValue, AvgValue, rank) as
    (line_no, line) rows laid out like pandas ``DataFrame.to_string``."""
    every = Window.partitionBy()
    tv, _ = _float_text(F.col("TotalValue"), every)
    av, _ = _float_text(F.col("AvgValue"), every)
    t = vtable.select("Segment", "rank",
                      F.format_string("% d", F.col("Records")).alias("r"),
                      tv.alias("t"), av.alias("a"))
    w_i = F.greatest(F.lit(len("Segment")), F.max(F.length("Segment")).over(every))
    w_r = F.greatest(F.lit(len(" Records")), F.max(F.length("r")).over(every))
    w_t = F.greatest(F.lit(len(" TotalValue")), F.max(F.length("t")).over(every))
    w_a = F.greatest(F.lit(len(" AvgValue")), F.max(F.length("a")).over(every))
    t = t.select("*", w_i.alias("wi"), w_r.alias("wr"), w_t.alias("wt"), w_a.alias("wa"))

    def pad(n: Column) -> Column:
        return F.repeat(F.lit(" "), n)

    header = F.concat(pad(F.col("wi") + 1), F.lpad(F.lit(" Records"), F.col("wr"), " "), F.lit(" "),
                      F.lpad(F.lit(" TotalValue"), F.col("wt"), " "), F.lit(" "),
                      F.lpad(F.lit(" AvgValue"), F.col("wa"), " "))
    names = F.concat(F.rpad(F.lit("Segment"), F.col("wi") + 1, " "),
                     pad(F.col("wr") + F.col("wt") + F.col("wa") + 2))
    row = F.concat(F.rpad(F.col("Segment"), F.col("wi") + 1, " "),
                   F.lpad(F.col("r"), F.col("wr"), " "), F.lit(" "),
                   F.lpad(F.col("t"), F.col("wt"), " "), F.lit(" "),
                   F.lpad(F.col("a"), F.col("wa"), " "))
    base = first_line_no
    heads = (t.where(F.col("rank") == 1)
             .select(F.inline(F.array(F.struct(F.lit(base).alias("line_no"), header.alias("line")),
                                      F.struct(F.lit(base + 1).alias("line_no"),
                                               names.alias("line"))))))
    rows = t.select((F.col("rank") + base + 1).cast("int").alias("line_no"), row.alias("line"))
    return heads.unionByName(rows)


def summary_report(title: str, health: DataFrame, vtable: DataFrame) -> DataFrame:
    """Title, underline, health lines and the value table."""
    spark = vtable.sparkSession
    head = [(1, title.upper()), (2, "=" * len(title)), (3, ""), (4, "Data health:")]
    h = health.select((F.col("line_no") + 100).cast("int").alias("line_no"),
                      F.concat(F.lit("  "), F.col("line")).alias("line"))
    mid = [(500, ""), (501, "Value by segment:")]
    fixed = spark.createDataFrame(head + mid, "line_no int, line string")
    return fixed.unionByName(h).unionByName(value_table_lines(vtable, 502))
