"""Graph operators against plain searches, on drawn graphs, long chains and the edges of nothing."""

import random

import pytest

from lexiforge.operators import graph


def reach(edges):
    """{(a, b): fewest edges} of all pairs with a path."""
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = {}
    for start in ahead:
        front, step = {start}, 0
        while front:
            step += 1
            front = {b for a in front for b in ahead.get(a, ())} - {b for (s, b) in out if s == start}
            out |= {(start, b): step for b in front}
    return out


def frame(spark, edges, kind="long"):
    return spark.createDataFrame(edges, f"src {kind}, dst {kind}")


def drawn(seed, nodes, n):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(12)] + [(12, 4)], drawn(1, 30, 34) + [(3, 3), (1, 2), (1, 2)]])
@pytest.mark.parametrize("finish", [0, 100])
def test_strong_components(spark, edges, finish):
    far = reach(edges)
    nodes = {x for e in edges for x in e}
    want = {n: max([n, *(m for m in nodes if (n, m) in far and (m, n) in far)]) for n in nodes}
    assert {r.node: r.component for r in graph.strong_components(frame(spark, edges), finish).collect()} == want


def test_acyclic_and_descendants(spark):
    edges = drawn(4, 40, 50)
    far = reach(edges)
    df = frame(spark, edges, "int")
    assert sorted(tuple(r) for r in graph.acyclic(df).collect()) == sorted({e for e in edges if e[0] != e[1] and (e[1], e[0]) not in far})
    of = spark.createDataFrame([(n,) for n in (1, 2, 3, 99)], "node int")
    assert {tuple(r) for r in graph.descendants(df, of).collect()} == {p for p in far if p[0] in (1, 2, 3) and p[0] != p[1]}
    assert {tuple(r) for r in graph.ancestors(df, of).collect()} == {(b, a) for a, b in far if b in (1, 2, 3) and a != b}


@pytest.mark.parametrize("wedges", [0, 20])
def test_many_components(spark, monkeypatch, wedges):
    """Triangles that hang together, cycles of five, a component of more nodes than a part: by short cycles or colours alone, without a table sent to the driver."""
    monkeypatch.setattr(graph, "WEDGES", wedges)
    monkeypatch.setattr(graph, "PART", 4)
    edges = [(k, k // 3) for k in range(1, 60)] + [(k // 9, k) for k in range(10, 60, 5)] + [(k, k + 1) for k in range(100, 104)] + [(104, 100), (100, 5), (9, 200)]
    far = reach(edges)
    nodes = {x for e in edges for x in e}
    want = {n: max([n, *(m for m in nodes if (n, m) in far and (m, n) in far)]) for n in nodes}
    assert len(set(want.values())) > 5 and max(list(want.values()).count(c) for c in set(want.values())) > 8
    df = frame(spark, edges)
    made = graph.strong_components(df, 0)
    assert {r.node: r.component for r in made.collect()} == want
    assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
    of = spark.createDataFrame([(n,) for n in range(0, 60, 4)], "node long")
    assert sorted(tuple(r) for r in graph.descendants(df, of).collect()) == sorted(p for p in far if p[0] < 60 and p[0] % 4 == 0 and p[0] != p[1])
    assert sorted(tuple(r) for r in graph.ancestors(df, of).collect()) == sorted((b, a) for a, b in far if b < 60 and b % 4 == 0 and a != b)


def test_distances_go_as_far_as_paths(spark):
    edges = [(i, i + 1) for i in range(9)] + [(9, 0)]
    want = {p: d for p, d in reach(edges).items() if p[0] != p[1]}
    assert {(r.src, r.dst): r.dist for r in graph.distances(frame(spark, edges)).collect()} == want
    assert max(want.values()) == 9


def test_mean_hyperbolicity(spark):
    edges = drawn(6, 24, 40)
    far, nodes = reach(edges), frame(spark, edges).selectExpr("explode(array(src, dst)) AS node").distinct()
    quads = graph.drawn_quadruples(nodes, 5).collect()
    d = lambda a, b: far.get((a, b), 5) if a != b else 5
    deltas = []
    for q in quads:
        sums = sorted([d(q.a, q.b) + d(q.c, q.d), d(q.a, q.c) + d(q.b, q.d), d(q.a, q.d) + d(q.b, q.c)])
        deltas.append((sums[2] - sums[1]) / 2)
    got = graph.mean_hyperbolicity(frame(spark, edges), 5).first()
    assert len(quads) == 5 and (got.quads, got.mean, got.most) == (5, sum(deltas) / 5, max(deltas))
    assert len({x for q in quads for x in (q.a, q.b, q.c, q.d)}) == 20


def test_containment_edges(spark):
    rng = random.Random(9)
    draw = lambda n: [rng.choice("abcd") for _ in range(n)]
    terms = [(i, draw(rng.choice([1, 2, 3, 4, 5, 6]))) for i in range(40)] + [(50, []), (51, None)]
    defs = [(i, draw(rng.choice([0, 1, 2, 9, 14])), [i % 40, 1000 + i]) for i in range(25)] + [(99, None, [7])]
    has = lambda t, w: any(w[p : p + len(t)] == t for p in range(len(w) - len(t) + 1))
    want = {(t, x) for t, tw in terms if tw for _, w, own in defs if w and t not in own and has(tw, w) for x in own}
    got = graph.containment_edges(spark.createDataFrame(terms, "term long, words array<string>"), spark.createDataFrame(defs, "def_id long, words array<string>, defines array<long>"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_named_nodes_are_reached(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "string")
    of = spark.createDataFrame([("b",)], "node string")
    assert {tuple(r) for r in graph.descendants(edges, of).collect()} == {("b", "c"), ("b", "a"), ("b", "d")}
    assert {tuple(r) for r in graph.ancestors(edges, of).collect()} == {("b", "a"), ("b", "c")}
