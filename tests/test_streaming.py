from __future__ import annotations

from pyspark.sql import functions as F

from marklake.sources import corpora
from marklake.streaming import feed


def test_feed(spark, tmp_path):
    rows = corpora.order_notes(spark, "/root/testdata/sf0.001").limit(200).withColumn("modification_ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.monotonically_increasing_id() * 600))
    rows.write.parquet(str(tmp_path / "in"))
    stream = feed.statuses(feed.read(spark, str(tmp_path / "in")), "status")
    q = feed.run(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert set(r.value for r in out.collect()) <= {"F", "O", "P"} and out.count() > 0
