"""Documents that arrive in a folder, ingested as a stream.

The files of a batch are replaced one by one, with their vectors and their part of the index: an edited file leaves none
of its old units.  A batch that runs again after a failure writes the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone import schema
from siltstone.operators.store import Store
from siltstone.operators.units import extract


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw documents (Parquet, the columns of RAW_DOCS and ``arrived`` timestamp) as they land in ``folder``."""
    kind = schema.struct(schema.RAW_DOCS + ", arrived timestamp")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start(docs: DataFrame, store: Store, checkpoint: str, doc_system: str = "generic_md") -> StreamingQuery:
    """Ingests each batch into ``store``; ends when what is there has been read."""

    def publish(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy("framework", "source_file").agg(F.max_by(F.struct("content", "content_type"), "arrived").alias("d")).select("framework", "source_file", "d.*")
        store.replace_files(extract(latest, doc_system), latest)

    return docs.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def units_stream(docs: DataFrame, doc_system: str = "generic_md", delay: str = "1 day") -> DataFrame:
    """As :func:`start`, without a store: a stream of units in which each id comes once within ``delay``."""
    units = extract(docs, doc_system, carry=("arrived",))
    return units.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["id"])
