"""Symbol spelling: trimmed, upper case, `-` for `.`; blank and `nan` are no symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def symbol(c: Column | str) -> Column:
    """Normalised symbol, null where the value names nothing (null, blank, nan)."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.translate(F.upper(F.trim(c.cast("string"), F.lit(BLANKS))), ".", "-")
    return F.when((s != "") & (s != "NAN"), s)


def real(c: Column | str) -> Column:
    """A double with NaN turned into null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
