"""Verification of a stream of entries against catalog tables.

Each micro-batch runs the batch plan; results are appended as Parquet under the batch's number, so a batch that runs again after a
failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import lookup, verdict


def verify_stream(entries: DataFrame, catalog: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream; ``entries`` is a streaming DataFrame with the entries' columns. The catalog's titles are prepared once, for all batches."""
    side = lookup.prepared(catalog)

    def batch(rows: DataFrame, number: int) -> None:
        verdict.verify(rows, catalog, side).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
