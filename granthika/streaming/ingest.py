"""Incremental ingest as a stream: each micro-batch appends the texts that the store doesn't hold yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from granthika.operators.store import keep_first, only_new, text_key


def ingest(spark: SparkSession, arriving: str, schema: StructType, stored: str, checkpoint: str, order: str) -> StreamingQuery:
    """Reads parquet files that arrive in a folder and appends new texts to the table at `stored`.

    Of equal texts in one batch the first by `order` stays. A batch that is run again after a failure finds
    its rows stored already and appends nothing, so that the result is the same.
    """

    def append(batch: DataFrame, _: int) -> None:
        keyed = keep_first(batch.withColumn("text_key", text_key(F.col("text"))), [F.col("text_key")], [F.col(order)])
        only_new(keyed, spark.read.schema(keyed.schema).parquet(stored), F.col("text_key")).write.mode("append").parquet(stored)

    # The store is there before the first batch, empty if need be, so that no batch has to ask whether it is.
    spark.createDataFrame([], schema).withColumn("text_key", text_key(F.col("text"))).write.mode("append").parquet(stored)
    stream = spark.readStream.schema(schema).parquet(arriving)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
