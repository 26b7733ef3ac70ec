import math

import numpy as np
import pytest

from lodestar.llm import embeddings
from lodestar.llm.hnsw import Graph

SCHEMA = "vec_id long, embedding array<float>, id int, at string"


def clustered(seed, groups, dims=24, spread=0.02):
    """Groups of near copies, single vectors, and chains whose neighbours only are linked."""
    rng, out = np.random.default_rng(seed), []
    for size in groups:
        centre = rng.normal(size=dims)
        out += [(centre + spread * rng.normal(size=dims) * np.linalg.norm(centre) / math.sqrt(dims)) * rng.uniform(0.1, 9) for _ in range(size)]
    for _ in range(8):
        a, b = rng.normal(size=(2, dims))
        a /= np.linalg.norm(a)
        b = b - (b @ a) * a
        b /= np.linalg.norm(b)
        out += [math.cos(t) * a + math.sin(t) * b for t in np.arange(9) * 0.4]
    return rng.permutation(np.array(out, np.float32))


def brute_force(rows):
    """n_links and component by id, of rows (id, vector)."""
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    n_links = dict.fromkeys(range(len(rows)), 0)
    place = [k for k, (i, v) in enumerate(rows) if any(v is w and i == j for j, w in ok)]
    for k in place:
        for m in place:
            if k != m and len(rows[k][1]) == len(rows[m][1]):
                a, b = (np.array(rows[x][1], np.float64) for x in (k, m))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    n_links[k] += 1
                    links[rows[k][0]].add(rows[m][0])
    component = {}
    for i in sorted((i for i in links if i is not None)):
        todo = [i] if i not in component else []
        while todo:
            j = todo.pop()
            if j not in component:
                component[j] = i
                todo += links[j]
    return sorted((i or -1, n_links[k], component.get(i, -1), i is not None and component[i] == i) for k, (i, _) in enumerate(rows))


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = embeddings.linked(df, **options).collect()
    return sorted((r["row"]["vec_id"] or -1, r["n_links"], -1 if r["component"] is None else r["component"], r["kept"]) for r in got)


@pytest.mark.parametrize("shard", [90, 10_000])
def test_against_brute_force(spark, shard):
    vectors = clustered(shard, [60, 9, 2, 2, 3] + [1] * 120)
    rows = [(int(i) * 3 + 5, v.tolist()) for i, v in enumerate(vectors)]
    want = brute_force(rows)
    assert found(spark, rows, shard=shard) == want
    assert len({c for _, _, c, _ in want}) < len(rows) - 60


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 0.0], [1.0, 2.0, 0.1]
    rows = [(9, v), (4, w), (4, v), (None, v), (7, None), (8, []), (10, [0.0, 0.0, 0.0]), (11, [1.0, None, 2.0]), (12, [float("nan"), 1.0, 2.0]),
            (13, [float("inf"), 2.0, 0.0]), (14, [1.0, 2.0]), (15, [-1.0, -2.0, 0.0]), (16, [1e30, 2e30, 0.0]), (17, [1e-40, 2e-40, 0.0])]
    want = brute_force(rows)
    assert found(spark, rows) == want
    assert (9, 4, 4, False) in want and (4, 4, 4, True) in want
    assert found(spark, []) == []


def test_links_between_and_beyond_leaders(spark):
    # Many vectors at all angles around one: members of one leader that are linked, and some that are not, with others.
    rng = np.random.default_rng(3)
    centre, vectors = rng.normal(size=8), []
    for _ in range(500):
        away = rng.normal(size=8)
        away -= (away @ centre) * centre / (centre @ centre)
        t = rng.uniform(0, 1.0)
        vectors.append(math.cos(t) * centre / np.linalg.norm(centre) + math.sin(t) * away / np.linalg.norm(away))
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(vectors)]
    got, want = found(spark, rows, shard=200), brute_force(rows)
    assert sum(n for _, n, _, _ in want) > 10_000
    assert all(a[1] <= b[1] for a, b in zip(got, want))
    assert sum(n for _, n, _, _ in got) >= 0.97 * sum(n for _, n, _, _ in want)


def test_recall_of_the_graph():
    vectors = embeddings.directions(np.random.default_rng(0).normal(size=(6000, 24))).astype(np.float32)
    graph = Graph.build(vectors[:5000], 0.9999)
    near, sims = graph.search(vectors, 24)
    nearest = (vectors @ vectors[graph.rows].T).argmax(axis=1)
    assert graph.size == 5000 and (np.array(graph.rows)[graph.leader] == np.arange(5000)).all()
    assert (near[:5000, 0] == nearest[:5000]).mean() > 0.99 and (near[5000:, 0] == nearest[5000:]).mean() > 0.9


def test_audits_widen_the_beams():
    vectors = embeddings.directions(clustered(5, [3] * 300, dims=48))
    limits = embeddings.Limits(0.9)
    graph = Graph.build(vectors.astype(np.float32), limits.ball)
    broken = [np.full_like(own, -1) for own in graph.links]  # a graph without links finds nothing
    shard = embeddings.Shard(vectors, Graph(graph.vectors, broken, graph.leader, graph.size, graph.rows))
    _, _, counts = shard.answer(vectors, limits, own=False)
    assert counts.sum() == np.count_nonzero(vectors @ vectors.T >= 0.9)
