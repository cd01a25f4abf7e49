"""Nearest rows where many stand at one place, and vectors that are missing or equal."""

import time

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import spatial_join as sj
from cairn.operators.vectors import nearest_vectors


def test_nearest_join_at_few_places(spark):
    """30,000 queries and points each, at 3 places: their pairs, 3e8 and more, must not be made."""
    began = time.time()
    at = lambda c, n: (F.col("id") % 3 * n).cast("double").alias(c)
    queries = spark.range(30_000).select(F.col("id").alias("q"), at("x", 1), at("y", 2))
    points = spark.range(30_000).select(F.col("id").alias("p"), at("px", 1), at("py", 2))
    out = sj.nearest_join(queries, points, "q", "p", 4, 500.0)
    found = out.groupBy(F.col("q") % 3, "rn").agg(F.count("*"), F.min("p"), F.max("p"), F.max("d2")).collect()
    assert sorted(map(tuple, found)) == [(c, r, 10_000, c + 3 * (r - 1), c + 3 * (r - 1), 0.0) for c in range(3) for r in range(1, 5)]
    assert time.time() - began < 45


def test_nearest_join_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    q = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 40, (60, 2)))] + [(60, None, 1.0), (61, 5000.0, 5000.0)]
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 40, (90, 2)))] + [(90 + i, 7.0, 7.0) for i in range(30)] + [(120, 1.0, None)]
    out = sj.nearest_join(spark.createDataFrame(q, "q long, x double, y double"), spark.createDataFrame(p, "p long, px double, py double"), "q", "p", 5, 100.0)
    want = [(a, b, d, r + 1) for a, x, y in q if x is not None for r, (d, b) in enumerate(sorted(((x - u) ** 2 + (y - v) ** 2, b) for b, u, v in p if v is not None)[:5])]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_nearest_vectors_with_missing_and_equal_ones(spark):
    """Null vectors and numbers are last, as in SQL; ties, many of them between equal vectors, go by id."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(120)] + [(200, None), (201, [1.0, None, 1.0, 1.0])] + [(300 + i, [9.0, 9.0, 9.0, 9.0]) for i in range(2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    distance = lambda u, v: np.inf if u is None or v is None or None in u or None in v else float(np.sqrt(sum((a - b) ** 2 for a, b in zip(u, v, strict=True))))
    for k, block in ((3, 256), (121, 7)):
        got = nearest_vectors(table.where("vec_id % 20 = 0"), table, k, block)
        want = [(a, b, r + 1) for a, u in rows if a % 20 == 0 for r, (_, b) in enumerate(sorted((distance(u, v), b) for b, v in rows if b != a)[:k])]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert nearest_vectors(table.limit(0), table, 3).count() == 0 == nearest_vectors(table.limit(3), table.limit(0), 3).count()


def test_embedding_neighbours_asks_for_every_vector(spark):
    """The query gives each vector of its table its three nearest others."""
    from cairn.plans import registry
    from cairn.session import read_table

    sf = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, read_table(spark, sf, "embeddings").select("vec_id", "embedding").collect()))
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = [(int(ids[a]), int(ids[b]), r + 1) for a in range(len(ids)) for r, b in enumerate(np.lexsort((ids, d[a]))[:3])]
    assert sorted(map(tuple, registry.queries()["jon09_embedding_neighbours"](spark, sf).collect())) == sorted(want)
