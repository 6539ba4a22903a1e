"""The ingestion steps as a stream over arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.quality import validate
from ..sources.contracts import TableContract


def ingest_available(spark: SparkSession, path: str, contract: TableContract, checkpoint: str, sink: Callable[[DataFrame, DataFrame, int], None]) -> StreamingQuery:
    """Takes the files that have arrived, validates each micro-batch and hands (valid, rejected, batch number) to the sink.

    The batch number repeats when a batch is retried, so a sink that writes under
    it is idempotent.
    """

    def step(batch: DataFrame, number: int) -> None:
        checked = validate(batch.select(*contract.schema.names), contract).persist()
        sink(checked.filter("size(_errors) = 0").drop("_errors"), checked.filter("size(_errors) > 0"), number)
        checked.unpersist()

    stream = spark.readStream.schema(contract.schema).parquet(path)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
