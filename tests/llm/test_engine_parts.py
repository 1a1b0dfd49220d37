import random

import pytest
from pyspark.sql import functions as F

from nullweave.llm import engine


def plain(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "ring of mixed ids", "odd", "none"])
def test_components(spark, kind):
    rnd = random.Random(3)
    edges = {
        "random": [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)],
        "chain": [(k, k + 1) for k in range(700)],
        "ring of mixed ids": [(k * 7919 % 1009, (k + 1) * 7919 % 1009) for k in range(1009)],
        "odd": [(1, 1), (None, 2), (3, None), (5, 4), (5, 4), (4, 5), (-7, 5), (2**62, -(2**62))],
        "none": [],
    }[kind]
    got = engine.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == plain(edges) and got.count() == len(plain(edges))


def test_components_of_a_hub(spark):
    """A star of 100,000 leaves around a node in the middle of the ids, and its leaves in pairs."""
    hub = spark.range(1, 100_001).select(F.lit(50_000).alias("a"), F.col("id").alias("b"))
    pairs = spark.range(1, 50_000).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 - 1).alias("b"))
    got = engine.components(hub.union(pairs))
    assert got.count() == 100_000 and [r.component for r in got.select("component").distinct().collect()] == [1]


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        engine.components(spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long"), rounds=1)


def test_shared_folder(spark):
    class Elsewhere:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return None

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        engine.shared_dir(Elsewhere)
    assert engine.shared_dir(spark)
