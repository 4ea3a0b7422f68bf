"""An extension: records that arrive as a stream, with the same analysis. The batch engine has no streaming semantics to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marklake.functions import frontmatter as fm


def read(spark: SparkSession, path: str, schema: str = "path string, content string, modification_ts timestamp") -> DataFrame:
    """Records from files of a folder as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def statuses(stream: DataFrame, key: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of a frontmatter value by window of modification time; what is later than the watermark is dropped."""
    v = fm.entry(F.col("fm.entries"), key)["text"]
    d = fm.with_frontmatter(stream.withWatermark("modification_ts", late))
    return d.groupBy(F.window("modification_ts", window), v.alias("value")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "value", "n")


def run(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a table of files, once."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
