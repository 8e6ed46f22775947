"""Metadata of newly arrived OCR texts as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metadata import consent_records, contract_records, write_records
from ..sources.files import list_files, read_files

NAMES = "path string"


def record_arrivals(spark: SparkSession, path: str, arrivals: str) -> None:
    """Appends the names of all files below ``path``, but empty ones, that are not in the table ``arrivals`` yet; tasks list and compare them."""
    spark.createDataFrame([], NAMES).write.mode("append").parquet(arrivals)
    seen = spark.read.schema(NAMES).parquet(arrivals)
    list_files(spark, path).filter("length > 0").select("path").join(seen, "path", "left_anti").write.mode("append").parquet(arrivals)


def text_stream(spark: SparkSession, arrivals: str) -> DataFrame:
    """(path): names of files as they arrive.  The stream goes over their table, so the driver holds no name of a file."""
    return spark.readStream.schema(NAMES).parquet(arrivals)


def texts_of(names: DataFrame) -> DataFrame:
    """(path, text): whole files."""
    return read_files(names).select("path", F.col("content").cast("string").alias("text"))


def metadata_stream(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Contract and consent records of all files not seen before, one JSON file each below ``out``; stops when it has caught up.

    The projection is the batch one, so a stream over the same files gives the same rows.  A batch is a job named by its
    number: one that was committed before a restart is moved to its end and not written again, one that was not is written
    anew under the same names, so each record is there once.  Files are listed by tasks when the stream begins, and their
    names appended to a table in the checkpoint, over which the stream goes.
    """

    def store(batch: DataFrame, number: int) -> None:
        texts = texts_of(batch)
        records = contract_records(texts, "path").unionByName(consent_records(texts, "path"), allowMissingColumns=True)
        write_records(records.withColumn("path", F.col("doc_id")).drop("doc_id"), out, path, job=f"batch-{number}")

    arrivals = f"{checkpoint}/arrivals"
    record_arrivals(spark, path, arrivals)
    return text_stream(spark, arrivals).writeStream.foreachBatch(store).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
