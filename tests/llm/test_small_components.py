"""Components of few edges, and the disk that finished steps leave."""

import time

from terrace.llm import components
from terrace.llm.common import checkpoint, release


def test_few_edges_lie_in_few_partitions(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91)], "a long, b long").repartition(7)
    got = components.connected_components(links)
    assert got.rdd.getNumPartitions() <= 2
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(41)} | {(90, 90), (91, 90)}


def test_rounds_with_and_without_a_shuffle_agree(spark, monkeypatch):
    links = spark.createDataFrame([(i, (7 * i) % 60) for i in range(60)] + [(None, 1), (3, 3)], "a long, b long")
    one = {tuple(r) for r in components.connected_components(links).collect()}
    monkeypatch.setattr(components, "EDGES_A_TASK", 0)
    assert {tuple(r) for r in components.connected_components(links).collect()} == one


def test_release_frees_the_shuffles_of_checkpointed_steps(spark):
    rows = checkpoint(spark.range(1000).groupBy("id").count())
    count = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    before = count()
    release(spark)
    time.sleep(1)
    assert count() < before and rows.count() == 1000
