"""A stored index of vectors by cells, searched exactly: blocks that cannot hold a hit are not read.

Vectors belong to the nearest of some pivots, and a cell is cut into blocks of a size. Of
a block its pivot c, the largest distance r from it and the largest norm are stored: no
vector v in it has an inner product with q above min(q.c + |q| r, |q| norm). A query
first visits the block nearest to it; its k-th best there is a bound below, and of the
others it visits those alone whose bound above reaches it. Every hit is found, whatever
the vectors; how many blocks are visited depends on how they cluster.

Pivots are a stated number of vectors, the first by hash; they and the blocks'
descriptions go to all tasks, so BLOCK and PIVOTS should grow with a very large table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .order import scanned, total

PIVOTS, BLOCK = 64, 5_000
#: Queries that meet a block in one task.
ASKED = 5_000
#: What rounding may add to a bound.
SLACK = 1e-9


def build(vectors: DataFrame, path: str, pivots: int = PIVOTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Writes the index: path/vectors, in folders by block, and path/blocks. Null vectors are left out."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    chosen = rows.select(F.xxhash64("v").alias("h"), "v").distinct().orderBy("h").limit(pivots).collect()  # pivots at most
    centres = np.array([r["v"] for r in chosen]) if chosen else np.zeros((0, 1))
    kind = rows.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m = np.stack(b["v"].to_list())
            d = np.sqrt(np.maximum(((m[:, None, :] - centres[None]) ** 2).sum(2), 0)) if len(m) * centres.size < 1 << 24 else np.stack([np.sqrt(((centres - x) ** 2).sum(1)) for x in m])
            cell = d.argmin(1)
            yield b.assign(cell=cell.astype(np.int32), far=d[np.arange(len(m)), cell], norm=np.sqrt((m**2).sum(1)))

    near = rows.mapInPandas(assign, f"id {kind}, v array<double>, cell int, far double, norm double")
    # a cell's vectors in blocks, by their distance from the pivot; numbers run over ranges, so no task holds a cell
    placed = scanned(near, "cell", ["far", "id"], __n=total(F.lit(1)))
    placed = placed.withColumn("block", F.concat_ws("-", "cell", F.floor((F.col("__n") - 1) / block)))
    placed.drop("__n").repartition("block").write.partitionBy("block").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    told = read(spark, path, kind).groupBy("block", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm"), F.min("id").alias("first"))
    middle = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    told.join(F.broadcast(middle), "cell").select("block", "n", "far", "norm", "centre", "first").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    return spark.read.schema(f"id {kind}, v array<double>, cell int, far double, norm double, block string").parquet(f"{path}/vectors")


def _hits(visits: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): a query's k best in each block that it visits."""
    sizes = visits.groupBy("block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    asked = visits.join(queries, "query_id").join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    held = vectors.join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values("id")
            ids, m, asked = left["id"].to_numpy(), np.stack(left["v"].to_list()), right["query_id"].to_numpy()
            for i in range(0, len(right), 256):
                # rounded, so that equal vectors score alike wherever they stand in a block
                scores = (np.stack(right["q"].iloc[i : i + 256].to_list()) @ m.T).round(12)
                first = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out["query_id"] += np.repeat(asked[i : i + 256], first.shape[1]).tolist()
                out["id"] += ids[first].ravel().tolist()
                out["score"] += np.take_along_axis(scores, first, 1).ravel().tolist()
        return pd.DataFrame(out)

    types = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}
    left, right = held.select("block", "part", "id", "v").groupBy("block", "part"), asked.select("block", "part", "query_id", "q").groupBy("block", "part")
    return left.cogroup(right).applyInPandas(best, f"query_id {types['query_id']}, id {types['id']}, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(hits, visits): (query_id, id, score, rank), the k best by inner product, ties by id; and the (query_id, block) that were visited.

    queries: (query_id, query). Null queries find nothing.
    """
    described = spark.read.parquet(f"{path}/blocks")
    vectors = read(spark, path, described.schema["first"].dataType.simpleString())
    asked = stored(queries.select("query_id", F.col("query").cast("array<double>").alias("q")).where("q is not null"), "asked")
    kind = asked.schema["query_id"].dataType.simpleString()
    blocks = described.orderBy("block").toPandas()  # a row a block
    names, far, norm, size = blocks["block"].to_numpy(), blocks["far"].to_numpy(), blocks["norm"].to_numpy(), blocks["n"].to_numpy()
    centres = np.stack(blocks["centre"].to_list()) if len(blocks) else np.zeros((0, 1))

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(query_id, least, block, bound): least tells the blocks to visit first, enough of them for k hits."""
        for b in batches:
            if not len(b) or not len(names):
                continue
            q = np.stack(b["q"].to_list())
            length = np.sqrt((q**2).sum(1))[:, None]
            inner = q @ centres.T
            bound = np.minimum(inner + length * far, length * norm) + SLACK * (1 + length * norm)
            order = np.argsort(-(inner - length * far), axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.zeros_like(bound, bool)
            np.put_along_axis(first, order, before < k, axis=1)
            i, j = np.indices(bound.shape)
            yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[i.ravel()], "block": names[j.ravel()], "bound": bound.ravel(), "first": first.ravel()})

    bounds = stored(asked.mapInPandas(bounded, f"query_id {kind}, block string, bound double, first boolean"), "bounds")
    begun = stored(_hits(bounds.where("first").select("query_id", "block"), vectors, asked, k), "begun")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    least = begun.withColumn("n", rank).where(F.col("n") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.where("not first").join(least, "query_id", "left").where("least is null or bound >= least").select("query_id", "block")
    every = begun.unionByName(_hits(rest, vectors, asked, k)).withColumn("rank", rank).where(F.col("rank") <= k)
    visits = bounds.where("first").select("query_id", "block").unionByName(rest)
    return every.select("query_id", F.col("id").alias(id_col), "score", "rank"), visits
