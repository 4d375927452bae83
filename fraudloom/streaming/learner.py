"""The online learner as a stream: staged labels wait, analysts decide at once, and every batch leaves a version of the weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.config import FEATURES, SECOND
from fraudloom.operators.drift import committed_labels, staged_labels
from fraudloom.operators.models import OnlineLearner
from fraudloom.session import discard, materialize
from fraudloom.streaming.store import Snapshots, children

Z = [f"z_{f}" for f in FEATURES]
VERSION = "batch long, now_us long, learned long, bias double, weights array<double>"


class LearnerLog:
    """``foreachBatch`` handler over decisions with standardized features and, where an analyst has spoken, ``feedback`` (0 or 1).

    A row with feedback is learned from at once. Others are staged where rules and model agree (``drift.staged_labels``) and learned from
    once ``delay_s`` have passed in event time, unless feedback on the same event has come by then. A batch takes one gradient step over its
    ready rows, reduced on the executors to 24 sums, and writes the weights as version ``batch``; a repeated batch starts from the version
    before it. Waiting rows are a snapshot: only those staged within the delay, whatever the stream's age.
    """

    def __init__(self, folder: str, delay_s: int = 60, sample: int = 50, start: OnlineLearner | None = None):
        self.folder, self.delay, self.sample, self.start = folder, delay_s, sample, start or OnlineLearner()
        shape = "event_id string, staged_us long, staged_label int, " + ", ".join(f"{z} double" for z in Z)
        self.waiting = Snapshots(f"{folder}/waiting", T.StructType.fromDDL(shape))

    def learner(self, spark: SparkSession, batch_id: int | None = None) -> OnlineLearner:
        """The newest version, or the newest before a batch."""
        out = OnlineLearner(self.start.rate, self.start.alpha)
        out.weights, out.bias, out.learned = list(self.start.weights), self.start.bias, self.start.learned
        done = [b for b in children(spark, f"{self.folder}/weights", "batch=") if batch_id is None or b < batch_id]
        if done:
            row = spark.read.schema(VERSION).parquet(f"{self.folder}/weights/batch={done[-1]}").first()
            out.weights, out.bias, out.learned = list(row["weights"]), row["bias"], row["learned"]
        return out

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch, "learn")
        now = batch.agg(F.max("ts_us")).first()[0]
        if now is None:
            return
        fresh = staged_labels(batch.filter("feedback is null"), sample=self.sample).join(batch.select("event_id", *Z), "event_id")
        staged = self.waiting.read(spark, batch_id).unionByName(fresh.select("event_id", "staged_us", F.col("staged_label").cast("int").alias("staged_label"), *Z))
        staged = materialize(staged.dropDuplicates(["event_id"]), "staged")
        spoken = batch.filter("feedback is not null").groupBy("event_id").agg(F.max("feedback").cast("int").alias("label"), *[F.first(z).alias(z) for z in Z])
        ready = committed_labels(staged.select("event_id", "staged_us", "staged_label"), spoken.select("event_id", "label"), F.lit(now), self.delay)
        vectors = spoken.select("event_id", *Z).unionByName(staged.join(spoken, "event_id", "left_anti").select("event_id", *Z))
        ready = materialize(ready.join(vectors, "event_id"), "ready")
        learner = self.learner(spark, batch_id)
        learner.learn(ready)
        version = spark.createDataFrame([(batch_id, now, learner.learned, float(learner.bias), [float(w) for w in learner.weights])], VERSION)
        version.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/weights/batch={batch_id}")
        self.waiting.write(staged.join(ready, "event_id", "left_anti"), batch_id)
        for done in (batch, staged, ready):
            discard(done)

    def versions(self, spark: SparkSession) -> DataFrame:
        """All versions: one row a batch."""
        paths = [f"{self.folder}/weights/batch={b}" for b in children(spark, f"{self.folder}/weights", "batch=")]
        return spark.read.schema(VERSION).parquet(*paths) if paths else spark.createDataFrame([], VERSION)


def learn_stream(rows: DataFrame, folder: str, **options) -> LearnerLog:
    """Run the learner over everything available; ``rows``: a stream of what ``LearnerLog`` takes."""
    log = LearnerLog(folder, **options)
    query = rows.writeStream.foreachBatch(log).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return log
