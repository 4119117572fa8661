"""How many partitions a shuffle of a given size needs."""

from __future__ import annotations

PARTITION_BYTES = 256 << 20
# Below this a partition is not worth a task of its own.
LEAST_BYTES = 16 << 20

# Log text is about this much larger than its gzip file.
GZIP_RATIO = 8


def partitions_for(total_bytes: int, partition_bytes: int = PARTITION_BYTES) -> int:
    """Number of partitions that hold ``partition_bytes`` each.

    For an explicit repartitioning, and as ``spark.sql.shuffle.partitions`` of a
    session whose largest exchange has ``total_bytes``; adaptive execution joins
    partitions that turn out small.
    """
    return max(1, -(-total_bytes // partition_bytes))


def partitions_over(total_bytes: int, cores: int) -> int:
    """As :func:`partitions_for`, but no core is idle as long as each has :data:`LEAST_BYTES`."""
    return max(partitions_for(total_bytes), min(cores, partitions_for(total_bytes, LEAST_BYTES)))
