"""Alignment of a stream of pairs. Every answer on one row is stateless, so the same expressions run on a stream as on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans
from spanloom.operators.baselines import naive
from spanloom.plans.fixture import prepared


def align_stream(pairs: DataFrame) -> DataFrame:
    """(pairs' columns, n, first, starts, naive) of a batch or stream of (source, target)."""
    p = prepared(pairs)
    cand, last = F.col("cand"), F.col("last")
    out = p.withColumn("n", spans.count_alignments(cand)).withColumn("starts", spans.start_positions(cand, last)).withColumn("naive", naive())
    return out.select(*pairs.columns, "n", "first", "starts", "naive")


def for_each_batch(pairs: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Runs an operator that needs windows or recursion on each micro-batch; a batch replaces only its own folder, so one
    that is run again after a failure is written once."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
