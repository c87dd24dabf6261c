"""Cleaning of a stream of pairs, micro-batch by micro-batch. Beyond what a batch run needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.people import classify_contributors


def classify_stream(pairs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Hand each micro-batch, with decision and reason, to ``sink``; what is there is worked off, then it ends."""

    def each(batch: DataFrame, epoch: int) -> None:
        sink(classify_contributors(batch, **options).all_rows, epoch)

    return pairs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
