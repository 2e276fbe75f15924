"""Column access by literal name and sentences from templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    """The column called ``c``, whatever characters the name holds (a bare
    ``F.col`` reads a dot as a field access)."""
    return F.col("`" + c.replace("`", "``") + "`") if isinstance(c, str) else c


def sentence(template: str, **parts: Column | str) -> Column:
    """A text column from a template: ``{name}`` stands for a part. Like
    ``concat``, a NULL part makes the sentence NULL."""
    pieces = re.split(r"\{(\w+)\}", template)
    out = []
    for i, piece in enumerate(pieces):
        if i % 2:
            part = parts[piece]
            out.append(F.lit(part) if isinstance(part, str) else part)
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out) if out else F.lit("")
