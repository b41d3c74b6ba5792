"""Imports from a stream of documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorewell.plans.engine import Engine

DOCUMENTS = "idx string, passage string, extracted_entities array<string>, extracted_triples array<array<string>>, pos long"


def read_documents(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Documents that arrive as files of JSON rows in a folder. files: how many a batch takes at most."""
    reader = spark.readStream.schema(DOCUMENTS)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(path)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint folder. It goes with the folder: a stream that begins anew has another, and its batches are numbered anew."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def ingest_stream(engine: Engine, documents: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch is one import, and the commit of an import remembers the stream and the number of the batch. A batch that is repeated, as its import was committed but Spark
    didn't get to note that, is known by its number before anything of it is read. Passages that are there already, by content, aren't taken again from any batch; what is known grows
    with the store, not with a watermark. trigger: as for DataStreamWriter.trigger; by default all that is there now."""

    def run(batch: DataFrame, number: int) -> None:
        name = stream_id(batch.sparkSession, checkpoint)
        if number > engine.store.epochs().get(name, -1):
            engine.ingest(batch, epoch=(name, number))

    writer = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
