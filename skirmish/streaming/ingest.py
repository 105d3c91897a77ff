"""Matches as a stream: pair weights per event are kept up to date, batch by batch.  An extension of its own."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skirmish.operators import graph, resolve


def maintain_pairs(matches: DataFrame, participants: DataFrame, path: str, checkpoint: str, now: float, decay_rate: float) -> StreamingQuery:
    """Writes the pair weights of each batch of a stream of matches under ``path``/batch=N, so a batch that is done again
    replaces itself; readers sum over the batches."""

    def add(batch: DataFrame, number: int) -> None:
        weighted = resolve.weighted_matches(batch, now, decay_rate, beta=0)
        graph.event_row_edges(resolve.resolve(weighted, participants, share=False)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return matches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
