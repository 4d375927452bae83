"""Shared-resource graph: users, devices, addresses and /24 networks, and the components they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.config import SECOND, EngineConfig
from fraudloom.functions.scalars import subnet24
from fraudloom.operators.prefix import time_bucket
from fraudloom.session import discard, materialize


def click_edges(clicks: DataFrame, prefix: Column | None = None) -> DataFrame:
    """Edges user-device, device-address, address-/24 with their last sighting, one row per distinct edge.

    ``prefix`` separates independent graphs (for example one per time window) inside one edge table.
    """
    p = F.lit("") if prefix is None else F.concat(prefix.cast("string"), F.lit("|"))
    user, device = F.concat(p, F.lit("U:"), "user_id"), F.concat(p, F.lit("D:"), "device_id")
    ip, net = F.concat(p, F.lit("I:"), "ip_address"), F.concat(p, F.lit("S:"), subnet24(F.col("ip_address")))
    pairs = F.array(F.struct(user.alias("src"), device.alias("dst")), F.struct(device.alias("src"), ip.alias("dst")),
                    F.struct(ip.alias("src"), net.alias("dst")))
    return (clicks.select("ts_us", F.inline(pairs)).filter("dst is not null")
            .groupBy("src", "dst").agg(F.max("ts_us").alias("last_us")))


def live_edges(edges: DataFrame, as_of: Column, ttl_s: int = 900) -> DataFrame:
    return edges.filter(F.col("last_us") >= as_of - ttl_s * SECOND)


def _star(pairs: DataFrame) -> DataFrame:
    """(node, other) pairs with the smallest name seen around ``node``.

    The minimum is an aggregate (combined before the shuffle) and joins back as one row per node, so a node with very many
    neighbours is split by adaptive skew handling and never gathered.
    """
    least = pairs.groupBy("node").agg(F.min("other").alias("low")).withColumn("low", F.least("low", "node"))
    return pairs.join(least, "node")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) where component is the smallest node name of the component.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each round replaces edges by at most as many edges
    that point at smaller names; it ends when a round changes nothing. Lineage is cut every round.
    """
    links, mark = _cut(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
                       .filter("hi <> lo").distinct())
    while True:
        both = links.select(F.inline(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")),
                                             F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")))))
        large = _star(both).filter("other > node").select(F.col("other").alias("hi"), F.col("low").alias("lo"))
        down = large.filter("hi <> lo").distinct().select(F.col("hi").alias("node"), F.col("lo").alias("other"))
        small = _star(down).select(F.inline(F.array(F.struct(F.col("node").alias("hi"), F.col("low").alias("lo")),
                                                    F.struct(F.col("other").alias("hi"), F.col("low").alias("lo")))))
        before = links
        links, now = _cut(small.filter("hi <> lo").distinct())
        discard(before)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _cut(links: DataFrame) -> tuple[DataFrame, tuple]:
    """Write the links of a round; their count and an order-free checksum are three numbers on the driver."""
    out, h = materialize(links, "links"), F.xxhash64("hi", "lo")
    return out, tuple(out.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def node_type(node: Column) -> Column:
    return F.substring(F.regexp_extract(node, r"(?:^|\|)([UDIS]):", 1), 1, 1)


def component_profile(components: DataFrame) -> DataFrame:
    """Number of users, devices, addresses and networks per component."""
    kind = node_type(F.col("node"))
    return components.groupBy("component").agg(*[
        F.count(F.when(kind == code, 1)).alias(name)
        for code, name in (("U", "users"), ("D", "devices"), ("I", "ips"), ("S", "subnets"))])


def graph_score(users: Column, devices: Column) -> Column:
    size = F.greatest(users, devices)
    return F.lit(1.0) - F.exp(-F.greatest(size - 3, F.lit(0)) / F.lit(6.0))


def scored_components(components: DataFrame) -> DataFrame:
    return component_profile(components).withColumn("score", graph_score(F.col("users"), F.col("devices")))


def snapshot_components(clicks: DataFrame, config: EngineConfig) -> DataFrame:
    """Components of one graph per ``graph_ttl_s`` window; nodes are named ``window|type:id``."""
    window = time_bucket("ts_us", config.graph_ttl_s)
    return connected_components(click_edges(clicks, window))


def snapshot_scores(clicks: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """(window, device_id) with the profile and score of the device's component in that window.

    Windows are the batch form of expiring edges: each holds exactly the edges seen in it.
    """
    return node_scores(snapshot_components(clicks, config or EngineConfig()))


def node_scores(nodes: DataFrame) -> DataFrame:
    """``snapshot_scores`` of components that are already known (``snapshot_components``)."""
    profile = scored_components(nodes)
    devices = nodes.filter(node_type(F.col("node")) == "D")
    return devices.join(profile, "component").select(
        F.split_part("node", F.lit("|"), F.lit(1)).cast("long").alias("window"),
        F.expr("substring(node, instr(node, '|') + 3)").alias("device_id"), "component",
        F.col("users").alias("graph_users"), F.col("devices").alias("graph_devices"), F.col("ips").alias("graph_ips"),
        F.col("subnets").alias("graph_subnets"), F.col("score").alias("score_graph"))


def with_graph_score(clicks: DataFrame, scores: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    config = config or EngineConfig()
    windowed = clicks.withColumn("window", time_bucket("ts_us", config.graph_ttl_s))
    return windowed.join(scores.drop("component"), ["window", "device_id"], "left").drop("window")


def ego_subgraph(edges: DataFrame, components: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of the component of ``start`` and the edges among them."""
    home = components.filter(F.col("node") == start).select("component")
    nodes = components.join(home, "component", "left_semi").select("node", node_type(F.col("node")).alias("type"))
    inside = (edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
              .join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return nodes, inside.select("src", "dst")


def reached_within(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(origin, node, hop): nodes reached in 1..hops steps from each ``origin``, with the first hop that reached them.

    The origins are the named entities of a question, so the result is as large as what they reach.

    Frontier expansion: every step joins only the newest frontier with the edges and drops what is already known.
    """
    around = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")),
                                           F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))))
    seen = start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, hops + 1):
        nxt = (frontier.join(around, "node").select("origin", F.col("other").alias("node")).distinct()
               .join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        frontier = materialize(nxt, "frontier")
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0")


def user_campaign_edges(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("user_id", "campaign_id").agg(F.count(F.lit(1)).alias("clicks"), F.max("ts_us").alias("last_us"))
