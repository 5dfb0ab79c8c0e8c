"""Near-duplicate vectors over a robust-pruned flat graph.

Vectors of one label are dealt to overlapping cluster shards (groups that are
too large are split again, a bounded sample of each giving its centres).  Each
shard builds a robust-pruned graph over its vectors; the adjacency lists of a
vector from all its shards are united.  A search then starts for each vector
from the shard's medoids and from the vector's own place, goes greedily to where
it is near, and widens as long as what it reaches is in range.  Cosines are
computed in double precision from the vectors themselves.  A sample of vectors
is audited against all others, and shards overlap more if the audit asks for it.

Copies are one point.  A clump of near copies that outgrows a shard is a ball:
points within half the link angle of one centre are all linked with each other,
so they are counted, not compared, and may be dealt to shards by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.components import connected_components
from turnmill.llm.scratch import free, materialise

SHARD_ROWS = 1_000  # points that a shard is meant to have; groups beyond twice as many are split
SAMPLE_ROWS = 4_000  # points, about, that the centres of a group's shards are fitted on
CENTRES = 256  # of a group at most; its shards are split again if that makes them too large
LEVELS = 6
OVERLAPS = (3, 6, 12)  # shards of a point at the first split; the next number is taken if the audit finds too little
AUDIT_ROWS, RECALL = 1_000, 0.995  # points that are compared with all others, and the share of their links to be found

DEGREE, CANDIDATES, FAR, ALPHA = 16, 48, 4, 1.2  # edges of a point, those they are chosen from, edges by chance, slack of pruning
BEAM = 12
BALLS = 8  # of a group at most at each split

_GUARD = 1e-9  # of a cosine
_AT_ONCE = 1 << 17  # pairs


# ---- inside one shard or sample ----


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over unit rows, started at rows by chance."""
    rng = np.random.default_rng(len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 1024] @ centres.T).argmax(axis=1) for i in range(0, len(x), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def balls_of(x: np.ndarray, inside: float, least: float) -> list[tuple[np.ndarray, int]]:
    """Centres, with the number of rows within cosine ``inside``, of clumps of at least ``least`` rows, the largest first."""
    left, out = x, []
    while len(left) >= max(least, 2) and len(out) < BALLS:
        counts = np.concatenate([(left[i : i + 512] @ left.T >= inside).sum(axis=1) for i in range(0, len(left), 512)])
        near = left[left @ left[counts.argmax()] >= inside]
        centre = unit([near.mean(axis=0)])[0]
        within = left @ centre >= inside
        if within.sum() < least:
            break
        out.append((centre, int(within.sum())))
        left = left[~within]
    return out


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, the largest first."""
    some = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, axis=1), axis=1, kind="stable"), axis=1)


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row, both ways: of two candidates, one that the nearer one leads to is left out."""
    n, rng = len(x), np.random.default_rng(len(x))
    if n < 2:
        return [np.zeros(0, dtype=np.int64)] * n
    many, step = min(CANDIDATES, n - 1), max(1, min(256, (1 << 22) // n))
    heads, tails = [], []
    for i in range(0, n, step):
        rows = np.arange(i, min(n, i + step))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        near = _best(sims, many)
        far2 = 2 - 2 * np.take_along_axis(sims, near, axis=1)
        others, alive, at = x[near], np.ones(near.shape, dtype=bool), np.arange(len(rows))
        for _ in range(min(DEGREE, many)):
            pick = alive.argmax(axis=1)
            some = alive[at, pick]
            heads.append(rows[some])
            tails.append(near[at, pick][some])
            chosen = others[at, pick]
            alive &= ALPHA**2 * (2 - 2 * np.einsum("nd,nmd->nm", chosen, others)) > far2
            alive[at, pick] = False
            if not alive.any():
                break
        heads.append(np.repeat(rows, FAR))
        tails.append(rng.integers(0, n, len(rows) * FAR))
    head, tail = np.concatenate(heads), np.concatenate(tails)
    head, tail = np.r_[head, tail], np.r_[tail, head]
    first = np.r_[np.ones(len(head) // 2, dtype=bool), np.zeros(len(head) // 2, dtype=bool)]
    sims = np.concatenate([(x[head[i : i + _AT_ONCE]] * x[tail[i : i + _AT_ONCE]]).sum(axis=1) for i in range(0, len(head), _AT_ONCE)])
    by = np.lexsort((-sims, ~first, head))  # own edges first, then those of others, the nearest first
    head, tail = head[by], tail[by]
    place = np.arange(len(head)) - np.searchsorted(head, head)
    keep = (place < 2 * (DEGREE + FAR)) & (head != tail)
    head, tail = head[keep], tail[keep]
    bounds = np.searchsorted(head, np.arange(n + 1))
    return [np.unique(tail[a:b]) for a, b in zip(bounds, bounds[1:])]


def medoids_of(x: np.ndarray) -> np.ndarray:
    """Rows next to the centres of about as many clusters as the root of the rows' number."""
    centres = centres_of(x, max(1, math.isqrt(len(x))), 3)
    return np.unique(np.concatenate([(centres[i : i + 64] @ x.T).argmax(axis=1) for i in range(0, len(centres), 64)]))


def in_range(x: np.ndarray, graph: list[np.ndarray], medoids: np.ndarray, least: float) -> np.ndarray:
    """Pairs (a < b, as a * rows + b) with a cosine of at least ``least`` that the search of either finds."""
    n = len(x)
    width = max([1, *(len(g) for g in graph)])
    near = np.full((n, width), -1, dtype=np.int64)
    for i, g in enumerate(graph):
        near[i, : len(g)] = g
    found, step = [], max(1, min(512, (1 << 22) // n))
    for i in range(0, n, step):
        found.append(_search(x, near, medoids, np.arange(i, min(n, i + step)), least))
        if sum(map(len, found)) > 1 << 22:
            found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


def _search(x: np.ndarray, near: np.ndarray, medoids: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
    """One search a row, a step of all searches at once."""
    n, m = len(x), len(rows)
    seen = np.zeros(m * n, dtype=bool)
    pool = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]  # search, row, cosine: the best of each that aren't expanded
    floor = np.full(m, -3.0)  # the cosine of the last place in a full beam
    best = np.full((m, BEAM), -3.0)  # the beam's cosines
    pairs: list[np.ndarray] = []

    def look(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places among those that the search hasn't seen, with their cosines."""
        flat = np.unique(q * n + v)
        flat = flat[~seen[flat]]
        seen[flat] = True
        q, v = flat // n, flat % n
        sims = np.concatenate([np.zeros(0), *((x[rows[q[i : i + _AT_ONCE]]] * x[v[i : i + _AT_ONCE]]).sum(axis=1) for i in range(0, len(q), _AT_ONCE))])
        return q, v, sims

    def take(q: np.ndarray, v: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Report and return what is in range; offer the rest to the beams."""
        hit = sims >= least
        a, b = rows[q[hit]], v[hit]
        pairs.append((np.minimum(a, b) * n + np.maximum(a, b))[a != b])
        q2, v2, s2 = q[~hit], v[~hit], sims[~hit]
        better = s2 > floor[q2]
        pool[0], pool[1], pool[2] = np.r_[pool[0], q2[better]], np.r_[pool[1], v2[better]], np.r_[pool[2], s2[better]]
        by = np.lexsort((-s2, q2))
        place = np.arange(len(by)) - np.searchsorted(q2[by], q2[by])
        by, place = by[place < BEAM], place[place < BEAM]
        fresh = np.full((m, BEAM), -3.0)
        fresh[q2[by], place] = s2[by]
        best[:] = -np.sort(-np.concatenate([best, fresh], axis=1), axis=1)[:, :BEAM]
        floor[:] = best[:, -1]
        return q[hit], v[hit]

    every = np.arange(m)
    start_q, start_v = np.r_[np.repeat(every, len(medoids)), every], np.r_[np.tile(medoids, m), rows]
    front = take(*look(start_q, start_v))
    while True:
        q, v, s = pool
        keep = s >= floor[q]
        by = np.lexsort((-s[keep], q[keep]))
        q, v, s = q[keep][by], v[keep][by], s[keep][by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        now = place < 2
        pool[:] = [q[~now], v[~now], s[~now]]
        todo_q, todo_v = np.r_[front[0], q[now]], np.r_[front[1], v[now]]
        if not len(todo_q):
            break
        nexts = []
        for i in range(0, len(todo_q), _AT_ONCE // near.shape[1] + 1):
            own_q, own_v = todo_q[i : i + _AT_ONCE // near.shape[1] + 1], near[todo_v[i : i + _AT_ONCE // near.shape[1] + 1]]
            ok = own_v >= 0
            nexts.append(take(*look(np.broadcast_to(own_q[:, None], own_v.shape)[ok], own_v[ok])))
        front = np.concatenate([a for a, _ in nexts]), np.concatenate([b for _, b in nexts])
    return np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


# ---- Spark ----

_MEMBER = "grp long, path string, node long, n long, vec array<double>, primary boolean, ball string"


def _usable(label: Column, vec: Column) -> Column:
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return label.isNotNull() & vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda v: v != 0)


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _fit(key: tuple, table: pa.Table, threshold: float, overlap: int, shard_rows: int) -> pa.Table:
    """Centres and balls of one group from its sample."""
    n = table.column("total")[0].as_py()
    x = _vectors(table.column("vec"))
    x = x[np.argsort(table.column("node").to_numpy(), kind="stable")]
    share = n / len(x)
    inside = math.sqrt((1 + threshold) / 2) + _GUARD
    balls = balls_of(x, inside, max(shard_rows / 2 / share, 8))
    k = max(2, min(CENTRES, math.ceil(n * overlap / shard_rows), len(x) // 4))
    centres = centres_of(x, min(k, len(x)))
    blocks = [math.ceil(size * share / shard_rows) for _, size in balls]
    return pa.table({
        "grp": pa.array([key[0].as_py()], pa.int64()), "path": pa.array([key[1].as_py()]),
        "centres": pa.array([centres.ravel().tolist()], pa.list_(pa.float64())), "balls": pa.array([[v for c, _ in balls for v in c.tolist()]], pa.list_(pa.float64())),
        "blocks": pa.array([blocks], pa.list_(pa.int32())),
    })


def _deal(batches: Iterator[pa.RecordBatch], threshold: float, overlap: int) -> Iterator[pa.RecordBatch]:
    """Shards of each point of a group, whose fitted row comes before its points."""
    angle = math.acos(threshold)
    inside, shell = math.cos(angle / 2) + _GUARD, math.cos(min(math.pi, 1.5 * angle)) - _GUARD
    group = None
    for batch in batches:
        kind = batch.column(batch.schema.get_field_index("kind")).to_numpy()
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kind[i] != kind[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if kind[a] == 0:
                row = part.slice(0, 1).to_pylist()[0]
                group = (row["centres"], row["balls"], row["blocks"])
                continue
            x = _vectors(part.column(part.schema.get_field_index("vec")))
            dim = x.shape[1]
            centres = np.array(group[0]).reshape(-1, dim)
            balls = np.array(group[1]).reshape(-1, dim)
            path, primary = keys[a][1], part.column(part.schema.get_field_index("primary")).to_pylist()
            sims = x @ centres.T
            nearest = _best(sims, min(overlap, len(centres)))
            to_ball = x @ balls.T if len(balls) else np.zeros((len(x), 0))
            nodes = part.column(part.schema.get_field_index("node")).to_numpy()
            rows: list[tuple[int, str, bool, str | None]] = []
            for i in range(len(x)):
                own = int(to_ball[i].argmax()) if len(balls) and primary[i] and to_ball[i].max() >= inside else None
                if own is None:
                    rows += [(i, f"{path}/{c}", bool(primary[i] and k == 0), None) for k, c in enumerate(nearest[i].tolist())]
                else:
                    rows.append((i, f"{path}/b{own}.{_block(int(nodes[i]), group[2][own])}", True, f"{path}/b{own}"))
                rows += [(i, f"{path}/b{c}.{k}", False, None) for c in np.flatnonzero(to_ball[i] >= shell).tolist() if c != own for k in range(group[2][c])]
            at = pa.array([r[0] for r in rows])
            take = lambda name: part.column(part.schema.get_field_index(name)).take(at)
            columns = [take("grp"), pa.array([r[1] for r in rows], pa.string()), take("node"), take("n"), take("vec"), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "path", "node", "n", "vec", "primary", "ball"])


def _block(node: int, blocks: int) -> int:
    return (node * 0x9E3779B97F4A7C15 % 2**64 >> 32) % blocks


def _split(members: DataFrame, threshold: float, overlap: int, shard_rows: int, sample_rows: int) -> DataFrame:
    """Deal the points of groups to overlapping shards until none is too large; a ball's blocks stay."""
    done = []
    for level in range(LEVELS):
        sizes = members.filter("ball IS NULL").groupBy("grp", "path").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") > 2 * shard_rows)
        sizes = sizes.filter(~F.element_at(F.split("path", "/"), -1).startswith("b"))
        large = materialise(sizes.select(F.col("grp").alias("_grp"), F.col("path").alias("_path"), "total"), "large")
        if large.isEmpty():
            break
        same = (F.col("grp") == F.col("_grp")) & (F.col("path") == F.col("_path"))
        done.append(members.join(large, same, "left_anti"))
        mine = members.join(large, same).drop("_grp", "_path")
        draw = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
        ways = overlap if level == 0 else 2
        sample = mine.filter(draw < sample_rows / F.col("total")).select("grp", "path", "node", "vec", "total")
        fitted = sample.groupBy("grp", "path").applyInArrow(
            lambda key, table: _fit(key, table, threshold, ways, shard_rows), "grp long, path string, centres array<double>, balls array<double>, blocks array<int>")
        fitted = materialise(fitted, "fitted")
        salts = F.ceil(F.col("total") / (16 * shard_rows)).cast("int")
        heads = fitted.join(large, same).select("grp", "path", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "centres", "balls", "blocks")
        points = mine.select("grp", "path", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "node", "n", "vec", "primary")
        both = points.unionByName(heads, allowMissingColumns=True).repartition("grp", "path", "salt").sortWithinPartitions("grp", "path", "salt", "kind")
        members = materialise(both.mapInArrow(lambda batches: _deal(batches, threshold, ways), _MEMBER), "members")
    else:
        done.append(members)
        return _all(done)
    return _all([*done, members])


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _build(table: pa.Table) -> pa.Table:
    x, nodes = _vectors(table.column("vec")), table.column("node").to_numpy()
    graph, start = pruned_graph(x), np.zeros(len(x), dtype=bool)
    start[medoids_of(x)] = True
    return pa.table({
        "grp": table.column("grp"), "path": table.column("path"), "node": table.column("node"),
        "near": pa.array([nodes[g].tolist() for g in graph], pa.list_(pa.int64())), "medoid": pa.array(start),
    })


def _find(table: pa.Table, threshold: float) -> pa.Table:
    """Links of a shard's points that this shard counts, and each point's least partner by links found here."""
    x, nodes, n = _vectors(table.column("vec")), table.column("node").to_numpy(), table.column("n").to_numpy()
    place = {int(v): i for i, v in enumerate(nodes)}
    graph = [np.array([place[v] for v in near if v in place], dtype=np.int64) for near in table.column("near").to_pylist()]
    medoids = np.flatnonzero(table.column("medoid").to_numpy(zero_copy_only=False))
    found = in_range(x, graph, medoids, threshold)
    a, b = found // len(x), found % len(x)

    # a pair that meets in several shards is counted in the first; one inside a ball is counted with the ball
    lists = [sorted(p) for p in table.column("paths").to_pylist()]
    ids = {p: i for i, p in enumerate(sorted({p for some in lists for p in some}))}
    width = max(map(len, lists))
    shards = np.full((len(x), width), -1, dtype=np.int64)
    for i, some in enumerate(lists):
        shards[i, : len(some)] = [ids[p] for p in some]
    mine = ids[table.column("path")[0].as_py()]
    balls = np.array([hash(v) if v is not None else 0 for v in table.column("ball").to_pylist()])
    counts = np.zeros(len(x), dtype=np.int64)
    for i in range(0, len(a), _AT_ONCE):
        p, q = a[i : i + _AT_ONCE], b[i : i + _AT_ONCE]
        earlier = np.zeros(len(p), dtype=bool)
        for k in range(width):
            one = shards[p, k]
            earlier |= (one >= 0) & (one < mine) & (shards[q] == one[:, None]).any(axis=1)
        own = ~earlier & ~((balls[p] != 0) & (balls[p] == balls[q]))
        np.add.at(counts, p[own], n[q[own]])
        np.add.at(counts, q[own], n[p[own]])
    return pa.table({"node": table.column("node"), "links": pa.array(counts), "partner": pa.array(nodes[roots_of(len(x), a, b)])})


def _links(points: DataFrame, threshold: float, overlap: int, shard_rows: int, sample_rows: int) -> tuple[DataFrame, DataFrame]:
    """(node, links) of points that link with other points, and edges (a, b) that connect what links connect."""
    whole = points.select("grp", F.lit("").alias("path"), "node", "n", "vec", F.lit(True).alias("primary"), F.lit(None).cast("string").alias("ball"))
    members = materialise(_split(whole, threshold, overlap, shard_rows, sample_rows), "shards")
    known = members.groupBy("node").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.max("ball").alias("in_ball"))
    graph = members.groupBy("grp", "path").applyInArrow(_build, "grp long, path string, node long, near array<long>, medoid boolean")
    graph = materialise(graph, "graph")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    medoids = graph.select("grp", "path", "node", "medoid")
    ready = members.drop("ball", "primary").join(medoids, ["grp", "path", "node"]).join(united, "node").join(known.withColumnRenamed("in_ball", "ball"), "node")
    found = materialise(ready.groupBy("grp", "path").applyInArrow(lambda table: _find(table, threshold), "node long, links long, partner long"), "found")
    balls = members.filter("ball IS NOT NULL").groupBy("grp", "ball").agg(F.sum("n").alias("size"), F.min("node").alias("first"))
    inside = members.filter("ball IS NOT NULL").join(balls, ["grp", "ball"]).select("node", (F.col("size") - F.col("n")).alias("links"), F.col("first").alias("partner"))
    both = materialise(found.union(inside), "links")
    return both.groupBy("node").agg(F.sum("links").alias("links")), both.select(F.col("node").alias("a"), F.col("partner").alias("b")).filter("a <> b")


def audit(points: DataFrame, links: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> tuple[int, int]:
    """(links found, links there are) of a sample of points, each compared with all points of its group."""
    spark = points.sparkSession
    draw = points.select("node").orderBy(F.xxhash64("node", F.lit("audit"))).limit(rows)
    asked = points.join(F.broadcast(draw), "node").select("node", "grp", "vec").collect()  # a bounded sample
    by: dict[int, tuple[list, list]] = {}
    for r in asked:
        of = by.setdefault(r["grp"], ([], []))
        of[0].append(r["node"])
        of[1].append(r["vec"])
    shared = spark.sparkContext.broadcast({g: (np.array(nodes), unit(vecs)) for g, (nodes, vecs) in by.items()})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            groups, nodes, n = (batch.column(i).to_numpy() for i in range(3))
            for g in np.unique(groups):
                if int(g) in shared.value:
                    at = np.flatnonzero(groups == g)
                    x = _vectors(batch.column(3).take(pa.array(at)))
                    names, asked = shared.value[int(g)]
                    hit = (asked @ x.T >= threshold) & (names[:, None] != nodes[at][None, :])
                    for name, count in zip(names.tolist(), (hit * n[at]).sum(axis=1).tolist()):
                        total[name] = total.get(name, 0) + count
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "there"])

    there = points.select("grp", "node", "n", "vec").mapInArrow(compare, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    # what is found may be too much by a count, never: each link is counted once
    sums = there.join(links, "node", "left").agg(F.sum(F.least(F.coalesce("links", F.lit(0)), "there")), F.sum("there")).first()
    return int(sums[0] or 0), int(sums[1] or 0)


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = RECALL,
    shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Link rows of one label whose cosine is at least ``threshold`` and name their components.

    Returns id, ``n_links`` (other rows linked directly), ``component_id`` (the
    least id that links reach, itself included) and ``kept`` (whether it is its
    own).  Rows with a null label, or with a vector that is null, empty or zero or
    holds a null or a number that isn't finite, link with nothing; neither do
    vectors of unlike length.  Rows with equal vectors link, also where ids repeat;
    a null id is never the least of a component that has others, and alone it is
    kept.  Other columns are ignored; an empty table gives no rows.

    No pair below ``threshold`` is linked.  Links are those the search finds: a
    bounded sample of points is compared with all others, and shards overlap more
    (``OVERLAPS``) while less than ``recall`` of its links are found.
    """
    label, vec = F.col(label_col), F.col(vec_col)
    good = _usable(label, vec)
    all_ = rows.select(F.col(id_col).alias("id"), F.when(good, label).alias("label"), F.when(good, vec.cast("array<double>")).alias("vec"))
    keys = all_.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("second"), F.reverse("vec")), "dim": F.size("vec")})
    one = ["label", "dim", "h1", "h2"]
    copies = keys.filter("vec IS NOT NULL").groupBy(*one).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec"))
    copies = materialise(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    groups = materialise(copies.select("label", "dim").distinct().withColumn("grp", F.monotonically_increasing_id()), "groups")
    points = materialise(copies.join(groups, ["label", "dim"]).select("grp", "node", "n", "vec"), "points")
    for overlap in OVERLAPS:
        links, edges = _links(points, threshold, overlap, shard_rows, sample_rows)
        found, there = audit(points, links, threshold)
        if found >= recall * there:
            break
    roots = materialise(connected_components(edges), "roots").withColumnRenamed("root", "_root")
    named = copies.select(*one, "node", "least", "n").join(roots, "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    named = materialise(named.join(links, "node", "left"), "named")
    least = named.groupBy("_root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "_root").select(*one, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = keys.filter("vec IS NOT NULL").select("id", *one).join(classes, one).select("id", "n_links", "component_id")
    alone = keys.filter("vec IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    free(points)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
