"""Streams: files once into bronze, bronze into keyed tables, all with available-now triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.contracts import Contract
from tidemark.sources.landing import scan
from tidemark.sources.store import Store


def ingest(spark: SparkSession, landing: str, bronze: str, checkpoint: str, contract: Contract) -> None:
    """Takes each file of a landing folder once and appends its parsed rows with lineage to Parquet. A rerun without new
    files does nothing."""
    rows = scan(spark, landing, contract, streaming=True)
    query = rows.writeStream.format("parquet").option("path", bronze).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def each_batch(spark: SparkSession, bronze: str, checkpoint: str, apply: Callable[[DataFrame, int], None], schema=None) -> None:
    """Runs ``apply`` on each micro-batch of new bronze rows. The batch is kept in memory and on disk for the call, since
    rules, metrics and merge read it in turn."""
    source = spark.readStream.schema(schema or spark.read.parquet(bronze).schema).parquet(bronze)

    def once(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            apply(batch, number)
        finally:
            batch.unpersist()

    source.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_once(store: Store, name: str, rows: DataFrame, writer: str, number: int) -> None:
    """Appends a micro-batch's rows with the batch as transaction: replayed after a failure, it adds nothing."""
    store.append(name, rows, txn=(writer, number))
