"""Continuous ingestion of facts into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factfade.operators.writes import remember_batch
from factfade.sources.store import compact, load_memory, publish, read_manifest


def ingest_stream(
    facts: DataFrame, root: str, checkpoint: str, as_of, scope: str = "global", **trigger
) -> StreamingQuery:
    """Write a stream of facts to a store, one version per micro-batch.

    ``as_of`` is an instant or a function of the micro-batch number.  The last number
    of the checkpoint goes into the manifest, so a micro-batch that is replayed after a
    failure changes nothing.  Tables of many small folders are compacted on the way.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest = read_manifest(spark, root, scope)
        if manifest.holds(f"{checkpoint}#{number}"):
            return
        moment = as_of(number) if callable(as_of) else as_of
        change = remember_batch(load_memory(spark, root, scope), batch, moment)
        publish(spark, root, scope, change, expected=manifest.version, batch=f"{checkpoint}#{number}")
        compact(spark, root, scope)

    return (
        facts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
