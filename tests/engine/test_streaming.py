"""Folds of growing lists give what the same folds give on the whole table."""

from pyspark.sql import functions as F

from nidifold.functions import aggregates as agg
from nidifold.streaming import fold, fold_by_time


def test_fold_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events")
    found = [agg.count_("n"), agg.max_("m", F.col("value"))]
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    fold(stream, ["event_type"], found).writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start().awaitTermination()
    want = events.groupBy("event_type").agg(*[a.column() for a in found])
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, want.collect()))


def test_fold_by_time(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    fold_by_time(stream, "ts", "1 day", "1 hour", ["event_type"], [agg.count_("n")]).writeStream.outputMode("update").format("memory").queryName("by_time").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("by_time").agg(F.sum("n")).collect()[0][0] == events.count()
