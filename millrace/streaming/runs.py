"""Streams over stored event files, run to their end and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; local only where no shared one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def store(spark: SparkSession):
    """Writes a table to a shared folder and reads it back, which cuts the lineage between rounds."""
    folder = shared_folder(spark).replace("/stream-", "/rounds-")

    def save(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the stored table's schema. The path is given as a pattern, since a stream takes a single file only that way."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(stream: DataFrame, timeout: int = 600) -> DataFrame:
    """Writes an append stream to Parquet (exactly once, by its log) until the input is used up; returns the table."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout):
            raise TimeoutError("the stream did not end")
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
