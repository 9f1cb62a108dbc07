"""A stream gives what the batch operator gives on the same rows."""

from conftest import DATA, rows_of
from pyspark.sql import functions as F

from millrace.functions.ordering import DAY_US, micros
from millrace.operators import conditions, queues
from millrace.streaming import stateful


def events(df):
    return df.select("event_id", "user_id", micros("ts").alias("us"), "event_type", "value")


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def source(spark, tmp_path):
    batch = spark.read.parquet(f"{DATA}/events.parquet")
    folder = str(tmp_path / "in")
    batch.coalesce(1).write.parquet(folder)
    return events(batch), events(spark.readStream.schema(batch.schema).parquet(folder))


def test_expiring_batches(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    want = conditions.expiring_batches(batch, ["user_id"], "us", ["us", "event_id"], F.floor(F.col("us") / F.lit(DAY_US)), 4, 2 * DAY_US).select("user_id", "event_id", "batch")
    assert rows_of(drained(stateful.expiring_batches(stream, "user_id", "us", "event_id", 4, 2 * DAY_US), "expiring")) == rows_of(want)


def test_latest_value(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    want = queues.latest_value(batch.where("event_type = 'purchase'"), batch.where("event_type = 'view'"), ["user_id"], ["us", "event_id"], F.floor(F.col("us") / F.lit(DAY_US)), "value").select("user_id", "event_id", "latest", "is_old")
    tagged = stream.where("event_type in ('purchase', 'view')").withColumn("side", F.col("event_type") == "purchase")
    got = drained(stateful.latest(tagged, "user_id", "us", "event_id", "side", "value"), "latest")
    same = lambda rows: [tuple("None" if x == "nan" else x for x in r) for r in rows]
    assert same(rows_of(got)) == rows_of(want)


def test_first_in(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    want = queues.bounded(batch, ["user_id"], ["us", "event_id"], 3, "reject").select(*batch.columns)
    assert rows_of(drained(stateful.first_in(stream, "user_id", ["us", "event_id"], 3), "first_in")) == rows_of(want)


def test_running_latency(spark, tmp_path):
    from millrace.operators import tracking

    batch, stream = source(spark, tmp_path)
    want = tracking.latency_report(batch, "event_type", "value", ["us", "event_id"], 0, 10, 0)
    got = drained(stateful.latency_report(stream, "event_type", "value", ["us", "event_id"]), "report", "update")
    assert rows_of(got) == rows_of(want)
