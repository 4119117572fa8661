"""Checks of the physical order of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bootloom.operators.ordering import BOOT, carry

POSITION = ["file_name", "block_start", "line_no"]


def token_order_violations(lines: DataFrame, strict: bool = False, segment_lines: int = 1 << 20) -> DataFrame:
    """Lines whose token is lower than that of the line before them in the boot's files.

    ``strict`` reports equal tokens too.  Needs the positions that
    :func:`bootloom.sources.logs.read_raw_logs` records; they cannot be had back
    after a shuffle.
    """
    placed = lines.withColumn(
        "segment",
        F.struct("file_name", "block_start", F.expr(f"line_no div {int(segment_lines)}").alias("range")),
    )
    checked = carry(placed, before={"previous_token": F.col("logcat_token")}, keys=BOOT, order=POSITION)
    broken = F.col("logcat_token") < F.col("previous_token")
    if strict:
        broken = F.col("logcat_token") <= F.col("previous_token")
    return checked.where(broken).drop("segment")
