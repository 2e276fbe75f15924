"""Sources and sinks."""

from tiercraft.sources.readers import read_records, read_parquet_records, with_row_order
from tiercraft.sources.sinks import (write_csv, write_lines, write_template, roster,
                                     preview)

__all__ = ["read_records", "read_parquet_records", "with_row_order", "write_csv",
           "write_lines", "write_template", "roster", "preview"]
