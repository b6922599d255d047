"""Column helpers (projections P-1 … P-13).

All are built-in expressions, so they stay inside whole-stage codegen.

Deliberate deviations from the source dashboard:

* P-1/P-2: every row is parsed on its own (any ISO form); unparseable text
  becomes null instead of one inferred format for the whole column, and the
  comparison view does not raise on bad dates.
* P-11: a ratio over an empty set is null, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PY_WHITESPACE_CLASS

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c: ColumnOrName) -> Column:
    """P-1/P-2: lenient timestamp parse; text that is no timestamp → null.

    Accepts whatever a SQL cast accepts (``yyyy-MM-dd``, ``yyyy-MM-dd HH:mm:ss``
    with optional fraction, ``T`` separator).  Timestamps pass through.
    """
    return _col(c).try_cast("timestamp_ntz")


def as_date(c: ColumnOrName) -> Column:
    """P-3: truncate to the calendar day."""
    return F.to_date(_col(c))


def minutes(c: ColumnOrName, decimals: int = 1) -> Column:
    """P-4: seconds → minutes, rounded half-even like the dashboard's display."""
    return F.bround(_col(c) / F.lit(60.0), decimals)


def as_text(c: ColumnOrName) -> Column:
    """P-5: value as text for comparisons / search."""
    return _col(c).cast("string")


def prefix(c: ColumnOrName, n: int) -> Column:
    """P-6: first ``n`` characters, null-safe."""
    return F.substring(_col(c), 1, n)


def pct(num: ColumnOrName, den: ColumnOrName, decimals: int | None = 1) -> Column:
    """P-11: ``num * 100 / den``; null when the denominator is 0 or null.

    Rounded half-even (the dashboard's pandas rounding) unless ``decimals`` is
    None.
    """
    ratio = F.try_divide(_col(num).cast("double") * F.lit(100.0), _col(den).cast("double"))
    return ratio if decimals is None else F.bround(ratio, decimals)


def zero_if_null(c: ColumnOrName) -> Column:
    """P-13: null → 0 as bigint."""
    return F.coalesce(_col(c).cast("bigint"), F.lit(0).cast("bigint"))


def strip_py(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove all Unicode whitespace at both ends.

    ``trim`` only removes spaces, so a regex over the exact set of characters
    Python treats as whitespace is used instead.
    """
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(_col(c), f"^{ws}+|{ws}+$", "")


def signed_thousands(c: ColumnOrName) -> Column:
    """``f"{n:+,}"`` for an integer column (``+1,234`` / ``-56`` / ``+0``)."""
    return F.format_string("%+,d", _col(c).cast("bigint"))


def thousands(c: ColumnOrName) -> Column:
    """``f"{n:,}"`` for an integer column."""
    return F.format_string("%,d", _col(c).cast("bigint"))
