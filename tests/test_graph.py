"""Order-dependent graph operators against plain models on random graphs."""

import random
from collections import deque

import pytest
from lorebank.operators import graph, pairs
from pyspark.sql import functions as F

KINDS = ["Caused", "Supports", "Contradicts", "Supersedes", "Related"]


def make(spark, rows):
    return spark.createDataFrame(rows, "source long, target long, edge_type string, weight double, created_at_us long, valid_from_us long, valid_until_us long")


def random_edges(seed, n=14, m=30):
    rng = random.Random(seed)
    out = {(rng.randrange(n), rng.randrange(n), rng.choice(KINDS)) for _ in range(m)}
    return [(a, b, t, round(rng.uniform(0.3, 1.0), 2), 0, None, None) for a, b, t in sorted(out) if a != b]


def plain_bfs(rows, start, depth):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for a, b, *_ in rows:
            if a == x and b not in seen and seen[x] < depth:
                seen[b] = seen[x] + 1
                queue.append(b)
    return seen


def plain_belief(rows, start, value, depth=5):
    known, frontier = {start: value}, {start: value}
    for _ in range(depth):
        moved = {}
        for a, b, t, w, *_ in sorted(r for r in rows if r[0] in frontier and r[2] != "Related"):
            p, current = frontier[a], moved.get(b, known.get(b, 1.0))
            clamp = lambda x: max(0.0, min(1.0, x))
            moved[b] = {"Caused": p * w * 0.9, "Supports": clamp(current + (p - 1) * w * 0.5), "Contradicts": clamp(current - p * w * 0.7), "Supersedes": min(current, p * 0.1)}[t]
        frontier = {k: v for k, v in moved.items() if k not in known}
        known |= moved
    return known


@pytest.mark.parametrize("seed", [1, 2])
def test_traversals(spark, seed):
    rows = random_edges(seed)
    edges = make(spark, rows)
    start = spark.createDataFrame([(0,)], "id long")
    want = plain_bfs(rows, 0, 3)
    assert {r.id: r.depth for r in graph.bfs(edges, start, 3).collect()} == want
    far = plain_bfs(rows, 0, 99)
    for goal in (0, 5, 13, 99):
        path = graph.shortest_path(edges, 0, goal)
        assert (path is None) == (goal not in far)
        if path:
            assert len(path) - 1 == far[goal] and path[0] == 0 and path[-1] == goal
            assert all(any(r[0] == a and r[1] == b for r in rows) for a, b in zip(path, path[1:], strict=False))
    got = {r.id: round(r.confidence, 6) for r in graph.propagate_belief(edges, 0, 0.4).collect()}
    assert got == {k: round(v, 6) for k, v in plain_belief(rows, 0, 0.4).items()}


def plain_dfs(rows, start, depth):
    seen, stack = {}, [(start, 0)]
    while stack:
        x, d = stack.pop()
        if x in seen:
            continue
        seen[x] = d
        if d < depth:
            stack += [(b, d + 1) for b in sorted({b for a, b, *_ in rows if a == x}, reverse=True)]
    return list(seen.items())


def test_depth_first(spark):
    rows = random_edges(3)
    got = graph.dfs(make(spark, rows), 0, 3).orderBy("place").collect()
    assert [(r.id, r.depth) for r in got] == plain_dfs(rows, 0, 3)
    assert graph.dfs(make(spark, rows), 99, 3).count() == 0


def test_cycles(spark):
    edges = make(spark, [(a, b, "Caused", 1.0, 0, None, None) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 3), (5, 6)]])
    assert sorted(r.cycle for r in graph.detect_cycles(edges).collect()) == [[1, 2, 3], [3, 4]]


def test_contradictions_and_validity(spark):
    rows = [(1, 2, "Contradicts", 1.0, 0, None, None), (3, 1, "Contradicts", 1.0, 0, None, None), (1, 4, "Supports", 1.0, 0, None, None), (4, 5, "Contradicts", 1.0, 0, None, None), (6, 1, "Supports", 1.0, 0, 10, 20)]
    edges = make(spark, rows)
    assert sorted(r.id for r in graph.contradictions(edges, 1).collect()) == [2, 3, 5]
    assert [graph.at_time(edges, t).where("source = 6").count() for t in (9, 10, 19, 20)] == [0, 1, 1, 0]
    assert {r.id for r in graph.neighbours(edges, 1, ["Supports"], "incoming").collect()} == {6}


def test_state_resolution(spark):
    edges = spark.createDataFrame([(1, 10, "lives_in:a", 1), (1, 11, "lives_in:b", 5), (1, 12, "likes:c", 9), (2, 13, "uses", 3)], "source long, target long, label string, created_at_us long")
    assert [tuple(r) for r in graph.resolve_states(edges, graph.STATEFUL_RELATIONS).collect()] == [(1, 10, "lives_in", 1, 5)]


@pytest.mark.parametrize("block", [pairs.BLOCK_ROWS, 7])
def test_pairs_and_components(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(pairs, "BLOCK_ROWS", block)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 5))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(40, [0.0] * 5), (41, None), (42, [1.0])], "id long, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if unit[i] @ unit[j] > 0.8}
    got = pairs.similar_pairs(rows, 0.8)
    assert {(r.a, r.b) for r in got.collect()} == want and want
    between = pairs.pairs_between(rows.where("id % 2 = 0"), rows, 0.8)
    assert {(r.a, r.b) for r in between.collect()} == {p for i, j in want for p in ((i, j), (j, i)) if p[0] % 2 == 0}
    root = {i: i for e in want for i in e}
    for _ in range(50):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.root for r in pairs.components(got).collect()} == root
    assert pairs.components(got.limit(0)).count() == 0


def test_strengthen_keeps_the_first_edge(spark):
    edges = make(spark, [(1, 2, "Related", 0.9, 1, None, None)])
    out = graph.strengthened(edges, 1, 2, 0.2, 9)
    assert sorted(r.weight for r in out.collect()) == [0.9, 1.0]
    assert [r.weight for r in graph.latest_pair_edges(out).collect()] == [1.0]
    assert graph.nodes(out).orderBy(F.col("id")).collect()[0].id == 1


@pytest.mark.parametrize("vectors, hops", [(133, 12), (147, 13)])
def test_path_length_counts_as_its_sql_does(spark, tmp_path, vectors, hops):
    import duckdb
    from lorebank.plans.catalog import ORACLES, QUERIES
    from lorebank.sources import fixtures

    spark.range(vectors).withColumnRenamed("id", "vec_id").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLES["shortest_path_len"]).fetchall()
    assert want == [(h,) for h in [hops] if h <= 12]
    assert [tuple(r) for r in QUERIES["shortest_path_len"](spark, str(tmp_path)).collect()] == want
    edges = fixtures.edges(spark, str(tmp_path))
    assert len(graph.shortest_path(edges, 0, 100)) == hops + 1
    assert graph.shortest_path(edges, 0, 100, hops - 1) is None
