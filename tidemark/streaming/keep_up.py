"""Keeping a table up with a stream of rows: each batch appends what isn't there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def keep_up(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Appends the rows of ``stream`` whose key is new to the Parquet table at ``path``, each key once, and stops when
    everything that is available has been read. A batch that is run again after a failure adds nothing twice. Rows with a
    null key are left out."""
    schema = stream.schema

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(f"{key} IS NOT NULL").dropDuplicates([key])
        if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            rows = rows.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti").select(schema.names)
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
