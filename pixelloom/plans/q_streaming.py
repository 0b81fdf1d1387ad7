"""Queries that run a stream over a given table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import shared
from ..streaming import heartbeat
from . import derive
from .derive import with_sql


@query(with_sql("runs", query="SELECT task, count(*) AS attempted, count_if(success OR skipped) AS successful, count_if(skipped) AS skipped, count_if(NOT (success OR skipped)) AS failed, round(coalesce(sum(latency), 0), 6) AS seconds, min(latency) AS shortest, max(latency) AS longest FROM runs GROUP BY task"))
def heartbeat_totals(spark, sf_dir):
    """The progress of every task after its inference log has gone through the heartbeat's stream, read from the stream's state."""
    name, value = heartbeat.PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        path = f"{sf_dir}/events.parquet"
        r = derive.runs_of(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*"))  # a stream's path is a folder or a pattern
        results = r.select("task", F.col("success").alias("successful"), "skipped", F.col("latency").alias("seconds"))
        checkpoint = shared.new_path(spark, "heartbeat")
        heartbeat.run_to_end(heartbeat.beats(results, "task").writeStream.outputMode("update").option("checkpointLocation", checkpoint).format("noop").start())
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return heartbeat.final(spark, checkpoint).withColumn("seconds", F.round("seconds", 6))
