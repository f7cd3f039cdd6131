"""Connected components: against union by the smallest id, and what they cost the driver."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import common
from attestry.llm.common import BITMAP_BITS, bitmap_holds, bitmap_of, components, contract


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def edge_list(seed=3):
    """A path out of order, a star under its largest id, cliques of 1 to 5, loops, and edges given twice and backwards."""
    rng = random.Random(seed)
    path = rng.sample(range(-50, 50), 60)
    edges = [*zip(path, path[1:]), *((i, 999) for i in range(100, 140)), (7000, 7000), (2**62, -(2**62))]
    for k in range(2, 6):
        edges += [(1000 * k + i, 1000 * k + j) for i in range(k) for j in range(i)]
    edges += [(b, a) for a, b in edges[::3]] + edges[::4]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("at_once", [common.EDGES_AT_ONCE, 20, 1])
def test_components_match_union_find(spark, monkeypatch, at_once):
    """Lists that one task finishes, and longer ones."""
    monkeypatch.setattr(common, "EDGES_AT_ONCE", at_once)
    edges = edge_list()
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.component for r in got} == union_find(edges) and len(got) == len({r.node for r in got})


def test_components_of_nothing(spark):
    nothing = components(spark.createDataFrame([(4, 4), (None, 3)], "a long, b long"))
    assert nothing.columns == ["node", "component"] and nothing.collect() == []


def test_short_list_takes_few_jobs(spark):
    """Every stage costs the driver a buffer of 4 MB and compiled code: a round of joins for each doubling adds up."""
    edges = [(i, i + 1) for i in range(2000)]
    context = spark.sparkContext
    context.setJobGroup("components", "")
    try:
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        jobs = context.statusTracker().getJobIdsForGroup("components")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(2001), 0)
    assert len(jobs) <= 8


def test_contract():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        a, b = rng.integers(-seed, seed + 1, (2, rng.integers(0, 80)))
        ids, component = contract(a, b)
        assert dict(zip(ids.tolist(), component.tolist())) == union_find([*zip(a.tolist(), b.tolist())]) | {
            x: x for x in ids.tolist() if x not in union_find([*zip(a.tolist(), b.tolist())])}


def test_bitmap_reaches_the_driver_whole(spark):
    """Sparse pieces and full ones."""
    hashes = F.when(F.col("id") < 70_000, F.shiftleft("id", 64 - BITMAP_BITS)).otherwise(F.xxhash64("id"))
    df = spark.range(100_000).select(hashes.alias("h"))
    bits = bitmap_of(F.col("h"), df)
    want = np.unique(np.array([r.h for r in df.collect()], np.int64).view(np.uint64) >> np.uint64(64 - BITMAP_BITS))
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == want.tolist()
    assert bitmap_holds(bits, want << np.uint64(64 - BITMAP_BITS)).all()
