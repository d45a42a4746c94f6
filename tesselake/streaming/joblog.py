"""Live statistics over job logs (an extension: the batch operators need none of this)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "ts timestamp, batch long, path_b64 string, rc int, changed boolean, mirrors_added int, mirrors_deleted int, resyncs int"


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    """JSON lines as they are added to a folder."""
    return spark.readStream.schema(schema).json(path)


def window_counts(log: DataFrame, width: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Finished and failed files and actions by window; rows later than the watermark are dropped."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", width))
    return w.agg(F.count_if(F.col("rc") == 0).alias("finished"), F.count_if(F.col("rc") != 0).alias("failed"), F.sum("mirrors_added").alias("added"), F.sum("mirrors_deleted").alias("deleted"))
