"""The index of cells against brute force, and how much of it a search visits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexfold.operators import pruned


def brute(vectors, queries, k):
    out = set()
    for q, x in queries:
        scored = sorted(((-round(float(np.dot(x, v)), 12), i) for i, v in vectors if v is not None))
        out |= {(q, i, n) for n, (_, i) in enumerate(scored[:k], 1)}
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.concatenate([c + 0.05 * rng.normal(size=(100, 16)) for c in centres])
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)]
    return [*rows, *[(2000 + i, v[3].tolist()) for i in range(90)], (3000, [0.0] * 16), (3001, (5 * v[7]).tolist())]  # copies, nothing, a long one


def test_search_is_exact_and_visits_few_blocks(spark, tmp_path, clustered):
    df = spark.createDataFrame([*clustered, (4000, None)], "vec_id long, embedding array<double>").repartition(4)
    path = str(tmp_path / "i")
    pruned.build(df, path, pivots=24, block=40)
    queries = [(i, x) for i, x in clustered if i % 20 == 0]
    asked = spark.createDataFrame([*queries, (-1, None)], "query_id long, query array<double>")
    for k in (1, 3, 60):
        hits, visits = pruned.search(spark, path, asked, k)
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in hits.collect()} == brute(clustered, queries, k)
    hits, visits = pruned.search(spark, path, asked, 3)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.max("n")).first()[0] <= 40
    assert visits.count() == visits.distinct().count() < 0.5 * blocks.count() * len(queries)


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    pruned.build(df, str(tmp_path / "i"), pivots=5)
    asked = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, query array<double>")
    hits, _ = pruned.search(spark, str(tmp_path / "i"), asked, 5)  # fewer vectors than asked for, ties by id
    assert sorted((r["vec_id"], r["rank"]) for r in hits.collect()) == [(1, 1), (2, 2)]
    pruned.build(df.limit(0), str(tmp_path / "none"))
    hits, visits = pruned.search(spark, str(tmp_path / "none"), asked)
    assert hits.count() == visits.count() == 0
