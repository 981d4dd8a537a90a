"""Size checks before a broadcast.

Only a side that is already written as a table is measured, in bytes, by one
aggregate over it; anything else is left to Spark, whose adaptive execution
knows the size of a finished stage and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Bytes of values (as JSON, an upper bound) above which a join side is never broadcast.
BROADCAST_MAX_BYTES = 64 << 20


def value_bytes(written: DataFrame) -> int:
    """Bytes of the values of a written table (one number to the driver)."""
    return written.agg(F.sum(F.octet_length(F.to_json(F.struct(*written.columns))))).first()[0] or 0


def broadcast_if_small(written: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``F.broadcast(written)`` if its values take at most ``max_bytes``, else ``written``."""
    return F.broadcast(written) if value_bytes(written) <= max_bytes else written
