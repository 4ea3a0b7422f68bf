from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marklake.llm import graph


def solve(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("bound", [200_000, 5])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", bound)
    rng = random.Random(3)
    chain, star = [(i, i + 1) for i in range(100, 140)], [(500, 500 + i) for i in range(1, 30)]
    some = [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    edges = [(a, b) for a, b in [*chain, *star, *some, (5, 4), (5, 4), (7, 7)]]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in solve([e for e in edges if e[0] != e[1]]).items()}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_link_buckets(spark):
    rng = random.Random(5)
    rows = [(b, n, n % 7) for b in range(12) for n in rng.sample(range(60), 14)]
    true = lambda a, b: (a * 31 + b * 17) % 5 == 0 or abs(a - b) == 1
    members = spark.createDataFrame(rows, "bucket bigint, node bigint, rank int")
    ok = lambda d: d.filter(((F.col("a") * 31 + F.col("b") * 17) % 5 == 0) | (F.abs(F.col("a") - F.col("b")) == 1))
    comps, _ = graph.link_buckets(members, lambda a, b: F.lit(True), ok, "test")
    by = {}
    for b, n, _ in rows:
        by.setdefault(b, set()).add(n)
    want = solve([(x, y) for g in by.values() for x in g for y in g if x < y and true(x, y)])
    assert {r.node: r.comp for r in comps.collect()} == want
