"""Running a stream over what its input has now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from parlance.session import shared_dir


def to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a bounded run, from files in the shared folder, where its state is, too: in mode "complete" those of the last batch."""
    spark, at, done = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream_{uuid.uuid4().hex}", []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/{number}")  # a batch that is run again replaces its files
        done.append(number)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    batches = sorted(set(done)) if mode == "append" else done[-1:]
    return spark.read.schema(stream.schema).parquet(*[f"{at}/rows/{n}" for n in batches]) if batches else spark.createDataFrame([], stream.schema)
