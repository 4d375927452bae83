"""The shared tables every query reads: clicks, features and scored decisions, built once per source folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.config import EngineConfig
from fraudloom.functions.scalars import mask_ip
from fraudloom.operators.features import compute_features
from fraudloom.operators.fusion import fuse, reject_blocked
from fraudloom.operators.graph import node_scores, snapshot_components, with_graph_score
from fraudloom.operators.patterns import classify
from fraudloom.operators.reasons import explain, rule_factors
from fraudloom.operators.rules import evaluate_rules
from fraudloom.session import staged, together
from fraudloom.sources.clicks import blocked_by, deduplicate, load_clicks

CONFIG = EngineConfig()


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    """Deduplicated click log."""
    return staged(spark, "clicks", (folder, CONFIG), lambda: deduplicate(load_clicks(spark, folder)))


def features(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, "features", (folder, CONFIG), lambda: compute_features(clicks(spark, folder), CONFIG))


def graph_scores(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, "graph", (folder, CONFIG), lambda: node_scores(graph_nodes(spark, folder)))


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, "nodes", (folder, CONFIG), lambda: snapshot_components(clicks(spark, folder), CONFIG))


def score(table: DataFrame, graph: DataFrame | None, config: EngineConfig = CONFIG) -> DataFrame:
    """Rules, graph evidence, fusion, patterns and reasons on top of a feature table."""
    table = evaluate_rules(table, config)
    if graph is not None:
        table = with_graph_score(table, graph, config)
    missing = {f"score_{layer}": F.lit(None).cast("double") for layer in ("ml", "online", "anomaly", "graph")
               if f"score_{layer}" not in table.columns}
    missing |= {c: F.lit(None).cast("long") for c in ("graph_users", "graph_devices", "graph_ips", "graph_subnets")
                if c not in table.columns}
    table = table.withColumns({**missing, "score_rules": F.col("rule_score"), "ip_mask": mask_ip(F.col("ip_address")),
                               "is_blocked": F.lit(False)})
    table = fuse(table, config)
    suspicious = F.col("level").isin("HIGH", "CRITICAL")
    table = table.withColumn("factors", F.when(suspicious, rule_factors(F.col("rules_fired")))
                             .otherwise(rule_factors(F.array().cast("array<string>"))))
    return classify(explain(table, config))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row per click: click, features, layer scores, decision, reason and classification."""
    def build() -> DataFrame:
        clicks(spark, folder)
        return score(*together(lambda: features(spark, folder), lambda: graph_scores(spark, folder)))
    return staged(spark, "decisions", (folder, CONFIG), build)


def blocklist(spark: SparkSession) -> DataFrame:
    """Example blocklist: one user, one device, one address."""
    return spark.sql("select * from values ('user', 'U0'), ('device', 'D1'), ('ip', '45.9.0.7') as t(entity_type, entity_id)")


def enforced(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions with clicks of the example blocklist rejected."""
    table = decisions(spark, folder).drop("is_blocked")
    return reject_blocked(blocked_by(table, blocklist(spark)))
