"""Join helpers.

Broadcast policy: a side is broadcast by hint only when its size is bounded
and checked:

* ``lookup``: the fixed lookup tables (statuses, methods, roles ...). Their
  row count is verified once per DataFrame with ``limit(max + 1).count()``
  (a job that stops after ``max + 1`` rows); above the bound the hint is
  dropped and the planner's own strategy (sort-merge join, or a runtime
  broadcast decided by AQE from measured sizes) is used instead.
One-row values (room count, current max id, KPI totals) are not joined at
all: they are uncorrelated scalar subqueries (``DataFrame.scalar()``),
evaluated once and inlined.

Every other join is left to the planner: a static broadcast only under
``autoBroadcastJoinThreshold`` of estimated size, and AQE converts a
sort-merge join to a broadcast join only after measuring the real shuffle
output, so no unbounded side is ever broadcast blindly.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_MAX_ROWS = 10_000
# frame -> verdict, for as long as the frame lives
_CHECKED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def fits(df: DataFrame, max_rows: int = LOOKUP_MAX_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (checked once per frame)."""
    if df not in _CHECKED:
        _CHECKED[df] = df.limit(max_rows + 1).count() <= max_rows
    return _CHECKED[df]


def lookup(df: DataFrame, max_rows: int = LOOKUP_MAX_ROWS) -> DataFrame:
    """Broadcast a lookup table if it is within ``max_rows``, else join plainly."""
    return F.broadcast(df) if fits(df, max_rows) else df
