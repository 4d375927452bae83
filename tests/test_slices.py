"""What a micro-batch is given: whole slices of the log, and only its own clicks to describe."""

from pyspark.sql import functions as F

from fraudloom.operators.features import compute_features
from fraudloom.plans import stream_queries as Q


def batches(spark, folder, stream):
    seen = {}
    query = (stream.writeStream.foreachBatch(lambda b, i: seen.__setitem__(i, sorted(r[0] for r in b.select("ts_us").collect())))
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return [v for _, v in sorted(seen.items()) if v]


def test_every_batch_is_one_slice(spark, tmp_path):
    """Also when the first cut is the smallest time, and when a partition holds no row of a slice."""
    rows = spark.createDataFrame([(1, 5)] * 8 + [(2, 7)] * 2 + [(3, 9)] * 6, "id int, ts_us bigint").repartition(4, "id")
    whole = Q._stream(spark, "slices", str(tmp_path), rows, 3)
    assert batches(spark, tmp_path, whole) == [[5] * 8 + [7] * 2, [9] * 6]


def test_a_log_without_rows_is_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, ts_us bigint")
    assert batches(spark, tmp_path, Q._stream(spark, "no-rows", str(tmp_path), rows, 3)) == []


def test_marked_clicks_are_described_as_among_all(spark, clicks_of):
    table = clicks_of([{"ts": 1000 + i * 7.3, "user_id": f"U{i % 3}", "device_id": f"D{i % 2}", "ad_id": f"AD{i % 5}"} for i in range(90)])
    last = F.col("event_id") >= "e00060"
    want = {r["event_id"]: r for r in compute_features(table).filter(last).collect()}
    found = compute_features(table.withColumn("_last", last), only="_last")
    assert {r["event_id"]: r for r in found.collect()} == want and len(want) == 30
