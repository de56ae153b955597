"""Extension: texts from a file stream into the graph, each micro-batch an idempotent merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshlore.operators import graph, memory
from meshlore.sources.parquet import Store


def ingest(spark: SparkSession, source: str, schema: str, extract: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str):
    """Start a query over JSON files. extract: texts -> (episode, entity, thesis, time); a replayed batch adds nothing, since t_ids are content."""

    def merge(batch: DataFrame, _: int) -> None:
        store.create(graph.triplets(memory.derive(extract(batch))).dropDuplicates(["t_id"]))

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
