"""Triangle meshes as vertex (vid, x, y, z) and face (fid, a, b, c) tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.ordered import numbered
from cairn.session import materialize


def weld(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of equal position become the one of least vid; degenerate faces and unused vertices go."""
    first = vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("to"))
    remap = vertices.join(first, ["x", "y", "z"]).select("vid", "to")
    out = faces
    for k in ("a", "b", "c"):
        out = out.join(remap.select(F.col("vid").alias(k), F.col("to").alias("_" + k)), k).drop(k).withColumnRenamed("_" + k, k)
    out = out.where("a <> b AND b <> c AND a <> c").select("fid", "a", "b", "c")
    used = out.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return vertices.join(used, "vid", "left_semi"), out


def half_edges(faces: DataFrame) -> DataFrame:
    """fid, u, v, lo, hi for each face's three directed edges."""
    e = F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]))
    return faces.select("fid", e.alias("e")).select("fid", "e.u", "e.v", F.least("e.u", "e.v").alias("lo"), F.greatest("e.u", "e.v").alias("hi"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Directed edges u, v whose undirected edge has one face."""
    return half_edges(faces).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.first("u").alias("u"), F.first("v").alias("v")).where("n = 1").select("u", "v")


def components(faces: DataFrame) -> DataFrame:
    """fid, label: faces joined through shared edges have the least fid among them.

    Each round takes the least label over each edge's faces and then jumps to the label's own label. Labels are tables
    in the shared folder, so a lost executor costs one round.
    """
    sides = materialize(half_edges(faces).select("fid", "lo", "hi"), "mesh-edges")
    labels = faces.select("fid", F.col("fid").alias("label"))
    while True:
        near = sides.join(labels, "fid").groupBy("lo", "hi").agg(F.min("label").alias("m"))
        best = sides.join(near, ["lo", "hi"]).groupBy("fid").agg(F.min("m").alias("m"))
        hooked = labels.join(best, "fid").select("fid", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        own = hooked.select(F.col("fid").alias("label"), F.col("label").alias("next"))
        step = materialize(hooked.join(own, "label").select("fid", "was", F.least("label", "next").alias("label")), "mesh-labels")
        labels = step.select("fid", "label")
        if step.where("label <> was").isEmpty():
            return labels


def largest_component(faces: DataFrame) -> DataFrame:
    """Faces of the component with most faces; of equal ones that of the least label."""
    labels = components(faces)
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "label").limit(1)
    return faces.join(labels, "fid").join(F.broadcast(best.select("label")), "label", "left_semi").drop("label")


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per face with the three vertices' coordinates: ax, ay, az, bx, ... and the face normal fx, fy, fz."""
    out = faces
    for k in ("a", "b", "c"):
        out = out.join(vertices.select(F.col("vid").alias(k), *[F.col(d).alias(k + d) for d in "xyz"]), k)
    d = lambda p, q, k: F.col(q + k) - F.col(p + k)
    u, v = [d("a", "b", k) for k in "xyz"], [d("a", "c", k) for k in "xyz"]
    normal = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return out.withColumns(dict(zip(("fx", "fy", "fz"), normal, strict=True)))


def _unit(cols: list[Column]) -> list[Column]:
    n = F.sqrt(sum((c * c for c in cols[1:]), cols[0] * cols[0]))
    return [F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in cols]


def vertex_normals(vertices: DataFrame, faces: DataFrame, weight: str = "area") -> DataFrame:
    """vid, nx, ny, nz: face normals summed over each vertex, by area or by the angle at the corner."""
    c = corners(vertices, faces)
    area = F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2 + F.col("fz") ** 2)

    def angle(p: str, q: str, r: str) -> Column:
        u, v = [F.col(q + k) - F.col(p + k) for k in "xyz"], [F.col(r + k) - F.col(p + k) for k in "xyz"]
        dot = sum((x * y for x, y in zip(u[1:], v[1:])), u[0] * v[0])
        size = F.sqrt(sum((x * x for x in u[1:]), u[0] * u[0])) * F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))
        return F.when(size * area > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size))) / area).otherwise(0.0)

    w = {"a": angle("a", "b", "c"), "b": angle("b", "c", "a"), "c": angle("c", "a", "b")} if weight == "angle" else dict.fromkeys("abc", F.lit(1.0))
    each = F.explode(F.array(*[F.struct(F.col(k).alias("vid"), w[k].alias("w")) for k in "abc"]))
    s = c.select("fx", "fy", "fz", each.alias("k")).groupBy("k.vid").agg(*[F.sum(F.col(f) * F.col("k.w")).alias(f) for f in ("fx", "fy", "fz")])
    return s.select("vid", *[n.alias(k) for n, k in zip(_unit([F.col(f) for f in ("fx", "fy", "fz")]), ("nx", "ny", "nz"))])


def smooth_normals(normals: DataFrame, faces: DataFrame, passes: int = 2) -> DataFrame:
    """Each normal half its own and half the mean over neighbours, counted once per triangle corner; ``passes`` times."""
    pairs = F.explode(F.array(*[F.struct(F.col(p).alias("vid"), F.col(q).alias("other")) for p in "abc" for q in "abc" if p != q]))
    links = faces.select(pairs.alias("p")).select("p.vid", "p.other")
    for _ in range(passes):
        near = links.join(normals.withColumnRenamed("vid", "other"), "other").groupBy("vid").agg(*[(F.sum(k) / F.count("*")).alias("m" + k) for k in ("nx", "ny", "nz")])
        mixed = [0.5 * F.col(k) + 0.5 * F.coalesce(F.col("m" + k), F.col(k)) for k in ("nx", "ny", "nz")]
        normals = normals.join(near, "vid", "left").select("vid", *[n.alias(k) for n, k in zip(_unit(mixed), ("nx", "ny", "nz"))])
    return normals


def clean(faces: DataFrame) -> DataFrame:
    """Without degenerate and repeated faces, and without faces on an edge that more than two faces have."""
    good = faces.where("a <> b AND b <> c AND a <> c").withColumn("k", F.array_sort(F.array("a", "b", "c")))
    good = good.join(good.groupBy("k").agg(F.min("fid").alias("fid")), ["k", "fid"], "left_semi").drop("k")
    e = half_edges(good)
    bad = e.groupBy("lo", "hi").agg(F.count("*").alias("n")).where("n > 2")
    return good.join(e.join(bad, ["lo", "hi"]).select("fid").distinct(), "fid", "left_anti")


def clip(vertices: DataFrame, faces: DataFrame, axis: str, at: float) -> DataFrame:
    """Triangles below the plane ``axis`` = ``at``, cut where they cross it: fid, part and nine coordinates.

    A triangle with one corner inside gives one part, with two gives two; corners on the plane are inside,
    but a triangle that only touches it gives none.
    """
    c = corners(vertices, faces)
    point = lambda k: F.struct(*[F.col(k + d).cast("double").alias(d) for d in "xyz"])
    inside = lambda k: F.col(k + axis) <= at

    def cut(p: str, q: str) -> Column:
        t = (F.lit(float(at)) - F.col(p + axis)) / (F.col(q + axis) - F.col(p + axis))
        return F.struct(*[(F.col(p + d) + (F.col(q + d) - F.col(p + d)) * t).alias(d) for d in "xyz"])

    tri = lambda *p: F.struct(*[v.alias(k) for v, k in zip(p, "pqr")])
    parts = F.when(inside("a") & inside("b") & inside("c"), F.array(tri(point("a"), point("b"), point("c"))))
    for p, q, r in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        parts = parts.when(inside(p) & ~inside(q) & ~inside(r), F.array(tri(point(p), cut(p, q), cut(p, r))))
        parts = parts.when(inside(p) & inside(q) & ~inside(r), F.array(tri(point(p), point(q), cut(q, r)), tri(point(p), cut(q, r), cut(p, r))))
    c = c.where(F.least(*[F.col(k + axis) for k in "abc"]) < at)
    return c.select("fid", F.posexplode(parts).alias("part", "t")).select("fid", "part", *[F.col(f"t.{k}.{d}").alias(k + d) for k in "pqr" for d in "xyz"])


def skirt(faces: DataFrame, vertices: DataFrame, drop: float) -> tuple[DataFrame, DataFrame]:
    """New vertices below the boundary and two triangles an edge: (vertices, faces) to add; ids follow the present ones."""
    edges = boundary_edges(faces)
    top = vertices.agg(F.max("vid")).first()[0] or 0
    last = faces.agg(F.max("fid")).first()[0] or 0
    ring = edges.select(F.col("u").alias("vid")).union(edges.select("v")).distinct()
    below = vertices.join(ring, "vid").select((F.col("vid") + top + 1).alias("vid"), "x", "y", (F.col("z") - drop).alias("z"))
    placed = numbered(edges.select("u", "v"), [], ["u", "v"], "n")
    lower = lambda k: F.col(k) + top + 1
    pair = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("u").alias("a"), lower("u").alias("b"), F.col("v").alias("c")), F.struct(F.lit(1).alias("k"), F.col("v").alias("a"), lower("u").alias("b"), lower("v").alias("c"))))
    walls = placed.select("n", pair.alias("t")).select((F.lit(last) + 2 * F.col("n") - 1 + F.col("t.k")).cast("long").alias("fid"), "t.a", "t.b", "t.c")
    return below, walls


def quadric_error(q: Column, x: Column, y: Column, z: Column) -> Column:
    """v^T Q v of a point for a symmetric 4 x 4 quadric stored as 10 numbers, row by row of the upper triangle."""
    g = lambda k: q[k]
    return g(0) * x * x + 2 * g(1) * x * y + 2 * g(2) * x * z + 2 * g(3) * x + g(4) * y * y + 2 * g(5) * y * z + 2 * g(6) * y + g(7) * z * z + 2 * g(8) * z + g(9)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the plane hull, counter-clockwise from the leftmost lowest (monotone chain)."""
    p = sorted({(float(x), float(y)) for x, y in points})
    if len(p) < 3:
        return np.array(p)
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(seq):
        out: list[tuple[float, float]] = []
        for v in seq:
            while len(out) > 1 and turn(out[-2], out[-1], v) <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hulls(points: DataFrame, key: str) -> DataFrame:
    """Hull corners (key, seq, x, y) of each group's points.

    Of the points with one x only the lowest and highest can be corners; a partial aggregate keeps these before any
    group is gathered.
    """
    kind = dict(points.dtypes)[key]

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        h = convex_hull(f[["x", "y"]].to_numpy())
        return pd.DataFrame({key: f[key].iloc[0], "seq": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    ends = points.groupBy(key, F.col("x").cast("double").alias("x")).agg(F.min("y").cast("double").alias("lo"), F.max("y").cast("double").alias("hi"))
    ends = ends.select(key, "x", F.explode(F.array("lo", "hi")).alias("y"))
    return ends.groupBy(key).applyInPandas(solve, f"`{key}` {kind}, seq long, x double, y double")
