"""Streams: sentences in, statements out.

Matching keeps no state: each micro-batch of annotated sentences meets the static pattern library. Upserts
go by key, so a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factloom.plans.match import match, novel
from factloom.sources.stores import upsert


def stream_statements(annotations: DataFrame, patterns: DataFrame, sources: DataFrame, store: str, checkpoint: str, classes: DataFrame | None = None) -> StreamingQuery:
    """Match a stream of annotations and upsert the novel statements into a store, one version for each micro-batch."""

    def write(batch: DataFrame, _: int) -> None:
        found = novel(match(batch, patterns, classes), sources)
        upsert(batch.sparkSession, store, found.dropDuplicates(["hash"]), ["hash"])

    return annotations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
