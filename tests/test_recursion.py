"""Reachability against a breadth-first search: cycles, hot nodes, nulls, repeats, more nodes than are broadcast."""

import random
from collections import defaultdict, deque

import pytest

from tessera.operators import recursion
from tessera.operators.recursion import reach


def search(links, start, hops):
    to = defaultdict(set)
    for a, b in links:
        if a is not None and b is not None:
            to[a].add(b)
    found = {s: 0 for s in start if s is not None}
    queue = deque(found)
    while queue:
        at = queue.popleft()
        for b in to[at] if hops is None or found[at] < hops else ():
            if b not in found:
                found[b] = found[at] + 1
                queue.append(b)
    return found


@pytest.mark.parametrize("few, hops", [(100_000, None), (5, None), (5, 2)])
def test_reach_equals_a_search(spark, monkeypatch, few, hops):
    monkeypatch.setattr(recursion, "BROADCAST_NODES", few)
    monkeypatch.setattr(recursion, "HOT", 8)
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)] + [(7, k) for k in range(0, 300, 2)]
    links += [(k, k + 1) for k in range(1000, 1006)] + [(1006, 1000), (0, 1000), (7, 7), (None, 3), (3, None), (0, 7), (0, 7), (5000, 5001)]
    start = [0, 0, None, 9000]
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "from int, to int, node string")
    got = reach(df, spark.createDataFrame([(s,) for s in start], "node int"), hops).collect()
    want = search(links, start, hops)
    assert len(got) == len(want) and {r["node"]: r["hops"] for r in got} == want


def test_nothing_to_start_from(spark):
    links = spark.createDataFrame([(1, 2)], "from int, to int")
    none = spark.createDataFrame([], "node int")
    assert reach(links, none).collect() == []
    assert [tuple(r) for r in reach(links.limit(0), spark.createDataFrame([(4,)], "node int")).collect()] == [(4, 0)]
