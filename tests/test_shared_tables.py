import datetime

from fraudloom.operators import graph as G
from fraudloom.operators import incidents as I
from fraudloom.plans import analyst_queries as Q
from fraudloom.plans import tables as T


def test_components_are_searched_once_and_incidents_keep_narrow_rows(spark, tmp_path, monkeypatch):
    """Graph scores and incident keys share one component search; neither incident table carries the features of a click."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=40 * i), i % 20, "click", 1.0, f'{{"k": {i % 7}}}') for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    calls, search = [], G.connected_components
    monkeypatch.setattr(G, "connected_components", lambda edges: calls.append(1) or search(edges))
    scores, nodes = T.graph_scores(spark, str(tmp_path)), T.graph_nodes(spark, str(tmp_path))
    assert len(calls) == 1
    fresh = G.snapshot_scores(T.clicks(spark, str(tmp_path)), T.CONFIG)
    assert sorted(scores.collect()) == sorted(fresh.collect()) and nodes.count() > scores.count() > 0
    assert Q._keyed(spark, str(tmp_path)).columns == [*I.KEPT, "keys"]
    assigned = Q._assigned(spark, str(tmp_path))
    assert assigned.columns == [*I.KEPT, "incident"] and assigned.count() == Q._keyed(spark, str(tmp_path)).count() > 0
