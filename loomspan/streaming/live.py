"""An extension: arriving documents checked against a fixed set of references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from loomspan.plans import overlap


def check_stream(docs: DataFrame, refs: DataFrame | overlap.References, sink: Callable[[DataFrame, int], None], min_score: float = 0.58) -> DataStreamWriter:
    """Each micro-batch of ``docs`` (doc_id, text) goes through the check; ``sink`` gets its results and number.

    The references are cut and indexed once, before the first batch. Batches are independent: what a check
    writes is removed when its sink returns. The sink should be idempotent by the batch's number, as a batch
    may come again after a failure.
    """
    fixed = refs if isinstance(refs, overlap.References) else overlap.References.of(refs)

    def run(batch: DataFrame, number: int) -> None:
        results = overlap.check(batch, fixed, min_score=min_score)[1]
        try:
            sink(results, number)
        finally:
            overlap.release(results)

    return docs.writeStream.foreachBatch(run)
