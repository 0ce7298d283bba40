"""Components of edges: rounds that broadcast the smallest neighbours and rounds that shuffle them agree."""

import numpy as np
import pytest

from quire.llm import simhash


def plain_roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root) if find(x) != x}


def random_edges():
    rng = np.random.default_rng(3)
    chain = [(k, k + 1) for k in range(40)]
    hub = [(1000, 1000 - k) for k in range(1, 60)] + [(1000, 1500), (1500, 1501)]
    return chain + hub + [(int(a), int(b)) for a, b in rng.integers(2000, 2200, (120, 2))] + [(5, 5), (7, 6), (6, 7)]


@pytest.mark.parametrize("held", [0, 50, simhash.HELD])
def test_components_by_any_join(spark, held):
    edges = random_edges()
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = simhash.components(df, held).collect()
    assert {r.node: r.root for r in got} == plain_roots(edges) and len(got) == len(plain_roots(edges))


def test_small_rounds_run_fewer_tasks(spark):
    df = spark.createDataFrame(random_edges(), "a long, b long").repartition(5)
    tracker, tasks, key = spark.sparkContext.statusTracker(), {}, "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")                              # as for tables that Spark does not take for small by itself
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for held in (0, simhash.HELD):
            spark.sparkContext.setJobGroup(f"rounds-{held}", "rounds")
            simhash.components(df, held)
            jobs = tracker.getJobIdsForGroup(f"rounds-{held}")
            stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
            tasks[held] = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks[simhash.HELD] < tasks[0], tasks           # the fewer, the more shuffle partitions there are
