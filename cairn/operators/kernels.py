"""Mesh kernels that run on one tile's mesh at a time: simplification and polygon triangulation."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def simplify(vertices: np.ndarray, faces: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Collapse edges of least quadric error until ``target`` faces are left.

    Edges are taken from a heap; an entry is stale if either end has changed since. The merged vertex stands at the
    quadric's minimum, or the best of both ends and their middle where that is singular. Boundary edges weigh more by a
    plane across them, and a collapse that turns a face over is refused.
    """
    v, f = vertices.astype(float).copy(), faces.copy()
    q = np.zeros((len(v), 4, 4))
    p = v[f]
    n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, size, out=np.zeros_like(n), where=size > 0)
    plane = np.c_[n, -np.einsum("ij,ij->i", n, p[:, 0])]
    k = plane[:, :, None] * plane[:, None, :]
    for corner in range(3):
        np.add.at(q, f[:, corner], k)
    around: list[set[int]] = [set() for _ in v]
    for i, t in enumerate(f.tolist()):
        for a in t:
            around[a].add(i)
    edges: dict[tuple[int, int], list[int]] = {}
    for i, t in enumerate(f.tolist()):
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            edges.setdefault((min(a, b), max(a, b)), []).append(i)
    for (a, b), owners in edges.items():
        if len(owners) == 1:
            d = np.cross(v[b] - v[a], n[owners[0]])
            s = np.linalg.norm(d)
            if s > 0:
                wall = np.r_[d / s, -np.dot(d / s, v[a])]
                q[a] += 100 * np.outer(wall, wall)
                q[b] += 100 * np.outer(wall, wall)
    age, alive = [0] * len(v), np.ones(len(f), bool)

    def best(a: int, b: int) -> tuple[float, np.ndarray]:
        m = q[a] + q[b]
        choices = [v[a], v[b], (v[a] + v[b]) / 2]
        if abs(np.linalg.det(m[:3, :3])) > 1e-12:
            choices.insert(0, np.linalg.solve(m[:3, :3], -m[:3, 3]))
        errors = [float(np.r_[c, 1] @ m @ np.r_[c, 1]) for c in choices]
        i = int(np.argmin(errors))
        return errors[i], choices[i]

    heap = [(best(a, b)[0], a, b, 0, 0) for a, b in edges]
    heapq.heapify(heap)
    left = len(f)
    while left > target and heap:
        _, a, b, age_a, age_b = heapq.heappop(heap)
        if age[a] != age_a or age[b] != age_b or age[a] < 0 or age[b] < 0:
            continue
        _, at = best(a, b)
        gone = around[a] & around[b]
        flips = False
        for i in (around[a] | around[b]) - gone:
            old = v[f[i]]
            new = np.array([at if x in (a, b) else v[x] for x in f[i]])
            if np.dot(np.cross(old[1] - old[0], old[2] - old[0]), np.cross(new[1] - new[0], new[2] - new[0])) <= 0:
                flips = True
                break
        if flips:
            continue
        v[a], q[a] = at, q[a] + q[b]
        age[a], age[b] = age[a] + 1, -1
        for i in gone:
            alive[i] = False
            for x in f[i]:
                around[x].discard(i)
        left -= len(gone)
        for i in list(around[b]):
            f[i] = [a if x == b else x for x in f[i]]
            around[a].add(i)
        around[b].clear()
        for c in {int(x) for i in around[a] for x in f[i]} - {a}:
            heapq.heappush(heap, (best(a, c)[0], min(a, c), max(a, c), age[min(a, c)], age[max(a, c)]))
    f = f[alive]
    used, index = np.unique(f, return_inverse=True)
    return v[used], index.reshape(-1, 3)


def triangulate(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (corner numbers, in the ring's own sense) of a simple plane polygon, by cutting ears."""
    n = len(ring)
    area = sum(ring[i][0] * ring[(i + 1) % n][1] - ring[(i + 1) % n][0] * ring[i][1] for i in range(n))
    turn = lambda a, b, c: (ring[b][0] - ring[a][0]) * (ring[c][1] - ring[a][1]) - (ring[b][1] - ring[a][1]) * (ring[c][0] - ring[a][0])
    sign = 1 if area >= 0 else -1
    left, out = list(range(n)), []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            if sign * turn(a, b, c) <= 0:
                continue
            if any(all(sign * turn(x, y, p) >= 0 for x, y in ((a, b), (b, c), (c, a))) for p in left if p not in (a, b, c)):
                continue
            out.append((a, b, c))
            left.pop(k)
            break
        else:  # only flat corners are left
            left.pop(next((k for k in range(len(left)) if turn(left[k - 1], left[k], left[(k + 1) % len(left)]) == 0), 0))
    if len(left) == 3 and turn(*left) != 0:
        out.append(tuple(left))
    return out


def newell_normal(ring: np.ndarray) -> np.ndarray:
    """Normal of a polygon in space, its length twice the area."""
    nxt = np.roll(ring, -1, 0)
    return np.stack([((ring[:, i] - nxt[:, i]) * (ring[:, j] + nxt[:, j])).sum() for i, j in ((1, 2), (2, 0), (0, 1))])


def triangulate_surface(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a polygon in space, by the plane across its dominant axis, wound as the polygon is."""
    normal = newell_normal(ring)
    axis = int(np.argmax(np.abs(normal)))
    keep = [(1, 2), (2, 0), (0, 1)][axis]
    return triangulate(ring[:, keep])


def simplify_tiles(triangles: DataFrame, key: str, faces_per_tile: int) -> DataFrame:
    """Each tile's triangles (corners ax ... cz) simplified: key, fid, ax ... cz. A tile is one group, bounded by its size."""
    kind = dict(triangles.dtypes)[key]
    names = [k + d for k in "abc" for d in "xyz"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        v, index = np.unique(f[names].to_numpy(float).reshape(-1, 3), axis=0, return_inverse=True)
        v, t = simplify(v, index.reshape(-1, 3), faces_per_tile)
        return pd.DataFrame(v[t].reshape(-1, 9), columns=names).assign(**{key: f[key].iloc[0], "fid": np.arange(len(t))})[[key, "fid", *names]]

    return triangles.groupBy(key).applyInPandas(run, f"`{key}` {kind}, fid long, " + ", ".join(f"{n} double" for n in names))


def heightfield(cells: DataFrame, size: float, i: str = "i", j: str = "j", z: str = "z") -> DataFrame:
    """Two triangles for each 2 x 2 block of grid cells with heights: the stand-in for surface reconstruction."""
    from pyspark.sql import functions as F

    at = lambda di, dj, name: cells.select((F.col(i) - di).alias("i"), (F.col(j) - dj).alias("j"), F.col(z).cast("double").alias(name))
    quad = at(0, 0, "z00").join(at(1, 0, "z10"), ["i", "j"]).join(at(0, 1, "z01"), ["i", "j"]).join(at(1, 1, "z11"), ["i", "j"])
    corner = lambda k, di, dj: [((F.col("i") + di) * size).alias(k + "x"), ((F.col("j") + dj) * size).alias(k + "y"), F.col(f"z{di}{dj}").alias(k + "z")]
    tri = lambda *p: F.struct(*[c for k, (di, dj) in zip("abc", p) for c in corner(k, di, dj)])
    return quad.select("i", "j", F.posexplode(F.array(tri((0, 0), (1, 0), (0, 1)), tri((1, 0), (1, 1), (0, 1)))).alias("part", "t")).select("i", "j", "part", "t.*")
