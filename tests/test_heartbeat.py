"""The heartbeat over a stream of events: several batches, a restart, and the batch aggregate."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from pixelloom.plans import derive
from pixelloom.streaming import heartbeat


@pytest.fixture
def rocks(spark):
    name, value = heartbeat.PROVIDER
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, old) if old else spark.conf.unset(name)


def results(spark, sf_dir):
    r = derive.runs(spark, sf_dir)
    return r.select("task", "success", "skipped", "latency", "idx").select("task", F.col("success").alias("successful"), "skipped", F.col("latency").alias("seconds"), "idx")


def rounded(rows):
    return sorted((r["task"], r["attempted"], r["successful"], r["skipped"], r["failed"], round(r["seconds"], 6), r["shortest"], r["longest"]) for r in rows)


def test_beats_and_final_state_equal_the_aggregate(spark, sf_dir, tmp_path, rocks):
    own = results(spark, sf_dir).withColumn("part", F.pmod(F.hash("task", "idx"), F.lit(4)))
    schema = own.drop("part").schema
    src, ck, out = tmp_path / "src", str(tmp_path / "ck"), str(tmp_path / "out")
    src.mkdir()

    def add(k):
        own.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(src))

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        return heartbeat.beats(stream, "task", beat_ms=600).writeStream.outputMode("update").trigger(processingTime="200 milliseconds").option("checkpointLocation", ck).foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).start()

    add(0)
    q = start()
    try:
        add(1)
        deadline, due = time.time() + 90, own.where("part < 2").count()
        while time.time() < deadline and sum(p["numInputRows"] for p in q.recentProgress) < due:
            time.sleep(0.3)
    finally:
        q.stop()
    add(2)
    add(3)
    q = start()  # goes on from the checkpoint
    try:
        deadline, whole = time.time() + 120, rounded(heartbeat.aggregate(own, "task").collect())
        while time.time() < deadline:
            time.sleep(1)
            said = spark.read.schema(heartbeat.output_schema("task", schema["task"].dataType)).parquet(out).collect() if (tmp_path / "out").exists() else []
            last = {}
            for r in said:
                if r["task"] not in last or r["attempted"] > last[r["task"]]["attempted"]:
                    last[r["task"]] = r
            if rounded(last.values()) == whole:
                break
    finally:
        q.stop()
    assert rounded(last.values()) == whole, "the last beat of each key says it all"
    assert rounded(heartbeat.final(spark, ck).collect()) == whole
    per = {}
    for r in said:
        per.setdefault(r["task"], []).append((r["beat_ms"], r["attempted"]))
    assert max(map(len, per.values())) > 1
    for rows in per.values():
        rows.sort()
        assert all(b[0] - a[0] >= 600 and b[1] > a[1] for a, b in zip(rows, rows[1:])), "one row a beat, and none without results"


def test_final_is_exact_before_any_beat(spark, sf_dir, tmp_path, rocks):
    own = results(spark, sf_dir).limit(500)
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    own.write.parquet(src)
    stream = heartbeat.beats(spark.readStream.schema(own.schema).parquet(src), "task", beat_ms=3_600_000)
    heartbeat.run_to_end(stream.writeStream.outputMode("update").option("checkpointLocation", ck).format("noop").start())
    assert rounded(heartbeat.final(spark, ck).collect()) == rounded(heartbeat.aggregate(spark.read.parquet(src), "task").collect())
