"""Incremental load of new files: what is there now, once."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.sources import store as T


def load_new(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append the files of ``source`` that no earlier call has loaded to the Parquet table ``target``: the checkpoint is the ledger."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def load_into(spark: SparkSession, source: str, schema, store: str, checkpoint: str, name: Callable[[], F.Column] = lambda: F.col("_metadata.file_name"), between: Callable[[], None] = lambda: None) -> list[str]:
    """Load the files of ``source`` that are new into a ``store`` with a kept ledger, and what each batch said.

    The stream's id, which its checkpoint keeps, and a batch's number are its load's name. One that failed after its rows were written comes again with the same id and replaces
    them; one that the ledger has, or a lost checkpoint that lists old files again, adds nothing. ``name`` gives a row's
    source file.
    """
    said: list[str] = []
    started = threading.Event()
    meta = F.struct(F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    stream = spark.readStream.schema(schema).parquet(source).select("*", name().alias("source_file"), meta.alias("_file"))

    def batch(df: DataFrame, batch_id: int) -> None:
        started.wait()
        files = df.groupBy("source_file").agg(F.max("_file.size").alias("size"), F.max("_file.modified").alias("modified"))
        said.append(T.add(df.drop("_file"), files, store, f"{query.id}-{batch_id:012d}", between))

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.set()
    query.awaitTermination()
    return said
