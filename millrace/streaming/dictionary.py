"""Dense first-seen ids over a stream: each micro-batch extends a stored dictionary."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.keyset import extend

SCHEMA = "id long, key string, epoch long"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(id, key, epoch) of all batches so far; every epoch has a folder of its own."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)  # nothing yet


def read(spark: SparkSession, path: str) -> DataFrame:
    return stored(spark, path).select("id", "key")


def start(stream: DataFrame, key: str, order: str, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Keeps the dictionary of a stream's key column. A batch that is run again
    writes the same epoch again, in place of what it left."""

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        earlier = stored(spark, path).filter(F.col("epoch") < epoch).select("id", "key")
        new = extend(earlier, batch.withColumn("_k", F.col(key).cast("string")), "_k", order).join(earlier.select("key"), "key", "left_anti")
        new.select("id", "key", F.lit(epoch).cast("long").alias("epoch")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    w = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
