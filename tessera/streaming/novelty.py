"""First occurrences in an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_seen(stream: DataFrame, atom: list[str], time_col: str, within: str = "1 day") -> DataFrame:
    """Rows whose atom has not been seen within the watermark; the state kept is bounded by it."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark(atom)
