"""Incidents that grow and merge batch by batch, with ids that only ever become smaller names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.config import SECOND, EngineConfig
from fraudloom.operators.graph import connected_components
from fraudloom.operators.incidents import CAMPAIGN
from fraudloom.operators.prefix import with_island
from fraudloom.session import discard, materialize
from fraudloom.streaming.store import Snapshots, children

OPEN_RUNS = "key string, start_us long, last_us long, incident string"


class IncidentLog:
    """``foreachBatch`` handler over suspicious decisions with ``keys`` (``operators.incidents.incident_keys``).

    State: the runs of keys that a click may still extend, each with its first and last time and its incident. A batch appends to runs,
    links the runs of each click, and searches components among the links of this batch and the incidents of open runs alone. It writes
    the incident of each click and, where incidents merged, which name took over from which; a reader follows the names
    (``assigned``). After the last batch that equals the batch form (``operators.incidents.correlate``) for clicks that come in the order
    of time or, late, inside an open run of their key; a late click between two closed runs does not join them.
    """

    def __init__(self, folder: str, config: EngineConfig | None = None):
        self.folder, self.config = folder, config or EngineConfig()
        self.state = Snapshots(f"{folder}/open", T.StructType.fromDDL(OPEN_RUNS))

    def _gap(self):
        return F.when(F.col("key").startswith(CAMPAIGN), self.config.campaign_link_s).otherwise(self.config.incident_idle_s) * SECOND

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self.state.read(spark, batch_id)
        rows = batch.select("event_id", "ts_us", F.explode("keys").alias("key"))
        inside = F.col("start_us").isNotNull() & (F.col("ts_us") < F.col("last_us")) & (F.col("ts_us") >= F.col("start_us") - self._gap())
        placed = rows.join(before, "key", "left").withColumn("ts_us", F.when(inside, F.col("last_us")).otherwise(F.col("ts_us"))).select("event_id", "ts_us", "key")
        points = placed.unionByName(before.select(F.lit(None).cast("string").alias("event_id"), F.col("last_us").alias("ts_us"), "key"))
        points = materialize(points, "points")
        weak = F.col("key").startswith(CAMPAIGN)
        runs = (with_island(points.filter(~weak), ["key"], "ts_us", self.config.incident_idle_s, "start")
                .unionByName(with_island(points.filter(weak), ["key"], "ts_us", self.config.campaign_link_s, "start")))
        # A run that begins with the last click of an open run is that run.
        known = before.select("key", F.col("last_us").alias("start"), F.col("start_us").alias("_first"), "incident")
        runs = runs.join(known, ["key", "start"], "left").withColumn("start", F.coalesce("_first", "start"))
        runs = materialize(runs.withColumn("node", F.concat_ws("@", "key", "start")), "runs")
        nodes = runs.filter("event_id is not null").select("event_id", "node")
        hub = nodes.groupBy("event_id").agg(F.min("node").alias("src"))
        links = nodes.join(hub, "event_id").select("src", F.col("node").alias("dst"))
        held = runs.filter("incident is not null").select(F.col("incident").alias("src"), F.col("node").alias("dst"))
        labels = materialize(connected_components(links.unionByName(held).distinct()), "labels")
        name = lambda rows, node: rows.join(labels.select(F.col("node").alias(node), "component"), node, "left").withColumn("component", F.coalesce("component", node))
        assigned = name(hub, "src").select("event_id", F.col("component").alias("incident"))
        assigned.write.mode("overwrite").parquet(f"{self.folder}/assigned/batch={batch_id}")
        old = name(before.select(F.col("incident").alias("src")).distinct(), "src")
        old.filter("src <> component").select(F.col("src").alias("old"), F.col("component").alias("new")).write.mode("overwrite").parquet(f"{self.folder}/merged/batch={batch_id}")
        newest = batch.agg(F.max("ts_us")).scalar()
        after = name(runs.groupBy("key", "start", "node").agg(F.max("ts_us").alias("last_us")), "node")
        after = after.filter(F.coalesce(F.col("last_us") + self._gap() >= newest, F.lit(True)))
        self.state.write(after.select("key", F.col("start").alias("start_us"), "last_us", F.col("component").alias("incident")), batch_id)
        for done in (points, runs, labels):
            discard(done)

    def _read(self, spark: SparkSession, part: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{part}/batch={b}" for b in children(spark, f"{self.folder}/{part}", "batch=")]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def assigned(self, spark: SparkSession) -> DataFrame:
        """(event_id, incident) of all clicks so far, under the names that incidents have now."""
        merged = self._read(spark, "merged", "old string, new string")
        names = connected_components(merged.select(F.col("old").alias("src"), F.col("new").alias("dst")))
        rows = self._read(spark, "assigned", "event_id string, incident string")
        return rows.join(names.withColumnRenamed("node", "incident"), "incident", "left").select("event_id", F.coalesce("component", "incident").alias("incident"))


def correlate_stream(rows: DataFrame, folder: str, config: EngineConfig | None = None) -> IncidentLog:
    """Run the log over everything available; ``rows``: a stream with ``event_id``, ``ts_us``, ``keys``."""
    log = IncidentLog(folder, config)
    query = rows.writeStream.foreachBatch(log).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return log
