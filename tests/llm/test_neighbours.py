"""Near vectors against all pairs."""

from collections import Counter

import numpy as np
import pytest

from turnmill.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node long, `n` string, path string"


def brute(rows, threshold=0.93):
    """All pairs of one label."""
    out, by = Counter(), {}
    for i, (vec_id, vec, label) in enumerate(rows):
        good = label is not None and vec and all(v is not None and np.isfinite(v) for v in vec) and any(vec)
        by.setdefault((label, len(vec)) if good else i, []).append((vec_id, vec if good else None))
    for key, mine in by.items():
        if not isinstance(key, tuple):
            out[(mine[0][0], 0, mine[0][0], True)] += 1
            continue
        x = neighbours.unit(np.array([v for _, v in mine], dtype=np.float32))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        root = neighbours.roots_of(len(mine), *np.nonzero(near))
        for i, (vec_id, _) in enumerate(mine):
            least = min((mine[j][0] for j in np.flatnonzero(root == root[i]) if mine[j][0] is not None), default=None)
            out[(vec_id, int(near[i].sum()), least, vec_id == least)] += 1
    return out


def clump(rng, n, dim, spread):
    centre = rng.normal(size=dim)
    return [(centre + rng.normal(size=dim) * spread).astype(np.float32).tolist() for _ in range(n)]


def framed(spark, rows, parts=6):
    return spark.createDataFrame([(*r, 5, "n", "p") for r in rows], SCHEMA).repartition(parts)


def found(frame, **more):
    return Counter(map(tuple, neighbours.near_vectors(frame, **more).collect()))


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    vecs = [v for n in (1, 1, 2, 3, 30) for v in clump(rng, n, 16, 0.15)] + [rng.normal(size=16).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i, v, i % 3) for i, v in enumerate(vecs)]
    rows += [(1000 + i, r[1], r[2]) for i, r in enumerate(rows[:20])] + [rows[3], rows[3], (None, rows[4][1], rows[4][2]), (None, rng.normal(size=16).astype(np.float32).tolist(), 9)]
    rows += [(2000, [float(2 * x) for x in vecs[5]], rows[5][2]), (2001, None, 1), (2002, [0.0] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, [float("nan")] * 16, 1), (2005, [float("inf")] * 16, 1),
             (2006, [], 1), (2007, vecs[0], None), (2008, vecs[0][:8], 0), (2009, [1e38] * 16, 1), (2010, [1e-38] * 16, 1), (2011, [-x for x in vecs[0]], 0)]
    got = found(framed(spark, rows))
    assert got == brute(rows) and sum(r[1] > 0 for r in got) > 50


@pytest.mark.parametrize("spread", [0.05, 0.02])
def test_split_groups_and_clumps(spark, spread):
    """A label of most rows with a clump beyond a shard, dealt at several levels; the nearer the clump, the more of it is a ball."""
    rng = np.random.default_rng(2)
    vecs = clump(rng, 700, 24, spread) + [v for n in [2] * 60 + [5] * 20 for v in clump(rng, n, 24, 0.1)] + [rng.normal(size=24).astype(np.float32).tolist() for _ in range(600)]
    rows = [(int(i), v, 0 if i % 10 else 1) for i, v in zip(rng.permutation(len(vecs)), vecs)]
    frame = framed(spark, rows)
    got, want = found(frame, shard_rows=60, sample_rows=400), brute(rows)
    links = lambda rows: sum(r[1] * n for r, n in rows.items())
    there = {r[0]: r[1] for r in want}
    assert all(r[1] <= there[r[0]] for r in got)
    assert links(got) >= 0.99 * links(want) and sum((got & want).values()) >= 0.97 * len(rows)


def test_a_ball_links_all_its_points():
    rng = np.random.default_rng(3)
    x = neighbours.unit(clump(rng, 200, 32, 0.05) + [rng.normal(size=32).tolist() for _ in range(300)])
    inside = np.sqrt((1 + 0.93) / 2)
    (centre, size), = neighbours.balls_of(x, inside, 50)
    members = x[x @ centre >= inside]
    assert size == len(members) >= 190 and (members @ members.T >= 0.93).all()


def test_the_graph_is_searched_not_the_rows():
    rng = np.random.default_rng(4)
    x = neighbours.unit([v for n in [1] * 600 + [3] * 100 for v in clump(rng, n, 48, 0.1)])
    graph = neighbours.pruned_graph(x)
    assert max(map(len, graph)) <= 4 * (neighbours.DEGREE + neighbours.FAR) < len(x) / 4
    got = neighbours.in_range(x, graph, neighbours.medoids_of(x), 0.93)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert set(got) <= set(a * len(x) + b) and len(got) >= 0.99 * len(a)


def test_audit_counts_what_is_missing(spark):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(0, i, 1, v) for i, v in enumerate(clump(rng, 20, 8, 0.01))], "grp long, node long, n long, vec array<double>")
    links = spark.createDataFrame([(i, 10) for i in range(20)], "node long, links long")
    assert neighbours.audit(points, links, 0.93) == (200, 380)


def test_no_rows(spark):
    assert neighbours.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
