import pytest
from pyspark.sql import functions as F

from tessera.operators import stateful
from tessera.streaming import stores


def _stream(spark, tmp_path, df, name, parts=4):
    rows = df.orderBy("ts").collect()
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], df.schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")


def _drain(spark, out, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check-{name}").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


@pytest.fixture(scope="module")
def events(spark):
    stores.use_rocksdb(spark)
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.select("event_id", "user_id", "event_type", "ts").where("user_id < 8").withColumn("failed", F.col("event_id") % 3 == 0).withColumn("service", F.col("user_id") % 2)
    yield out.unionByName(out.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _same(got, want):
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(got) == rows(want) and got.count()


def _state_rows(spark, tmp_path, name):
    path = f"file://{tmp_path}/check-{name}"
    return {v: spark.read.format("statestore").option("stateVarName", v).load(path).count() for v in ("due",)}


def test_cache_as_a_stream_and_its_end(spark, tmp_path, events):
    late = spark.createDataFrame([(10**6, 10**6, "view")], "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-12-31 00:00:00").cast("timestamp")).withColumn("failed", F.lit(False)).withColumn("service", F.lit(9).cast("long"))
    last = late.withColumns({"ts": F.lit("2025-12-31 00:00:00").cast("timestamp"), "user_id": F.lit(10**7).cast("long"), "event_id": F.lit(10**7).cast("long")})
    both = events.unionByName(late.select(events.columns)).unionByName(last.select(events.columns))
    got = _drain(spark, stores.cache_hits(_stream(spark, tmp_path, both, "c", 6), 7200, delay="0 seconds"), tmp_path, "store_cache")
    _same(got.select("tie", "hit", "age_seconds").where("tie < 1000000"), stateful.cache_hits(events, 7200).select("event_id", "hit", "age_seconds"))
    # The watermark stands at the last event: only the key of that one, and none before it, has state.
    assert _state_rows(spark, tmp_path, "store_cache")["due"] <= 2


def test_breaker_as_a_stream(spark, tmp_path, events):
    got = _drain(spark, stores.circuit_breaker(_stream(spark, tmp_path, events, "b"), 86_400), tmp_path, "store_breaker")
    _same(got.select("tie", "made"), stateful.circuit_breaker(events, 86_400).select("event_id", "made"))


def test_sessions_as_a_stream(spark, tmp_path, events):
    got = _drain(spark, stores.bounded_sessions(_stream(spark, tmp_path, events, "s"), 2, 40_000), tmp_path, "store_sessions")
    _same(got.select("tie", "found", "evicted"), stateful.bounded_sessions(events, 2, 40_000).select("event_id", "found", F.col("evicted").cast("string")))
