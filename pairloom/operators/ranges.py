"""Global order over whole tables without a task that gets all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a range is meant to hold, and the most ranges.
RANGE_ROWS, MOST_RANGES = 5_000, 1_000


def in_ranges(df: DataFrame, order: str, rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """``df`` with ``range``, which rises with the numeric column ``order``, and the number of rows.

    The bounds are approximate percentiles, fixed as literals, so a row's range never
    depends on how rows are dealt. Equal values share a range. Nulls are in the first.
    """
    n = df.count()
    k = min(n // rows + 1, MOST_RANGES)
    bounds = []
    if k > 1:
        marks = df.agg(F.percentile_approx(order, [i / k for i in range(1, k)], 10 * MOST_RANGES)).first()[0]
        bounds = sorted(set(marks or []))

    def place(low: int, high: int) -> Column:
        """How many bounds are under the value, by halves."""
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(F.col(order) > bounds[mid], place(mid + 1, high)).otherwise(place(low, mid))

    return df.withColumn("range", place(0, len(bounds))), n
