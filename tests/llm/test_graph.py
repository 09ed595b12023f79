"""Components against a plain union-find; pairs that settle a large group of near copies against all of its links."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sedimenta.llm import graph, neardup
from sedimenta.llm.wordhash import mixed


def least_reachable(edges):
    least = {x: x for e in edges for x in e}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        least[max(a, b)] = min(a, b)
    return {x: root(x) for x in least}


@pytest.mark.parametrize("task_edges", [0, graph.TASK_EDGES])
def test_components(spark, task_edges):
    rng = random.Random(task_edges)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(-7, x) for x in range(1000, 1080)]
    some = [(rng.randrange(-300, -100), rng.randrange(-300, -100)) for _ in range(120)]
    edges = [*chain, *star, *some, chain[0], (5, 5), (2**63 - 1, -(2**63))]
    rng.shuffle(edges)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long"), task_edges=task_edges).collect()}
    assert got == {x: least for x, least in least_reachable(edges).items() if x != least}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_pairs_settle_a_group_of_independent_near_copies():
    """Copies edited in 0 to 12 places of 150 words, most pairs of which are below the bound: both rounds by their
    kernels lose at most 1 % of the links of brute force, with far fewer pairs than all."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(700):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(13)):
            w[k] = f"own{i}x{k}"
        texts.append(" ".join(w))
    sets = list({s.tobytes(): s for s in neardup.shingle_sets(pa.array(texts))}.values())
    n, edges = len(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    words = [neardup.majorities(mixed(np.concatenate(sets), 8 + j), edges) for j in range(4)]
    bits = np.unpackbits(np.stack(words, 1).view(np.uint8), axis=1, bitorder="little").astype(float)
    # the parts of a table of 20,000 independent fingerprints
    both = np.full((neardup.N_BITS, neardup.N_BITS), 5000.0) + np.eye(neardup.N_BITS) * 5000
    parts = [part for part, t in neardup.choose_parts(20_000, both)]
    assert bits.shape == (n, neardup.N_BITS) and len(parts) > 10

    def buckets(some):
        for part in some:
            value = bits[:, list(part)] @ 2.0 ** np.arange(len(part))
            for x in np.unique(value):
                at = np.flatnonzero(value == x)
                if len(at) > 1:
                    yield at, np.full(len(at), 3), [w[at] for w in words]

    def alike(u, v):
        common = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
        return common >= neardup.LIKENESS * (len(sets[u]) + len(sets[v]) - common)

    first: dict = {}
    for b in buckets(parts[::2]):
        for u, v, apart in neardup._nearest(*b):
            first[u] = min(first.get(u, (999, 0)), (apart, v))
    links = [(u, v) for u, (_, v) in first.items() if alike(u, v)]
    found = least_reachable([*links, *((i, i) for i in range(n))])
    label = np.array([found[i] for i in range(n)])
    rest = {x for at, side, w in buckets(parts) for x in neardup._across(at, side, w, label[at])}
    assert all(label[u] != label[v] for u, v in rest)
    found = least_reachable([*links, *((int(u), int(v)) for u, v in rest if alike(u, v)), *((i, i) for i in range(n))])
    true = [(u, v) for u in range(n) for v in range(u) if alike(u, v)]
    assert len(true) > 5000
    assert sum(found[u] != found[v] for u, v in true) <= 0.01 * len(true)
    assert len(first) + len(rest) < n * (n - 1) / 2 / 4
