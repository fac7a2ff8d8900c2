"""Exact vector retrieval, and the text a retrieved context becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..functions.vectors import inner
from .reshape import for_role


def top_k(vectors: DataFrame, query: list[float], k: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest by inner product, ties by id: scored in one pass, each task keeping k."""
    v = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(id_col, inner(F.col(vector_col), v).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Vectors, and queries, of a block; a task holds one block of each.
BLOCK = 20_000


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 3, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for every row of queries (query_id, query): the k nearest by inner product, ties by id.

    Vectors and queries are dealt into blocks of a size, by counts; each pair of blocks
    is a product of matrices that keeps its k best for a query, and these few meet.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    def blocks(df: DataFrame) -> int:
        return max(1, -(-df.count() // block))

    def visited(df: DataFrame, name: str, by: str, own: int, other: str, others: int) -> DataFrame:
        """df in own blocks, a copy for each block of the others."""
        return df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    n_v, n_q = blocks(vectors), blocks(queries)
    v = visited(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "a", "id", n_v, "b", n_q)
    q = visited(queries.select("query_id", F.col("query").cast("array<double>").alias("q")), "b", "query_id", n_q, "a", n_v)
    types = {f.name: f.dataType.simpleString() for f in [*v.schema, *q.schema]}

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if len(left) and len(right):
            left = left.sort_values("id")
            ids, m, asked = left["id"].to_numpy(), np.stack(left["v"].to_list()), right["query_id"].to_numpy()
            for i in range(0, len(right), 256):
                # rounded, so that equal vectors score alike wherever they stand in a block
                scores = (np.stack(right["q"].iloc[i : i + 256].to_list()) @ m.T).round(12)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out["query_id"] += np.repeat(asked[i : i + 256], best.shape[1]).tolist()
                out["id"] += ids[best].ravel().tolist()
                out["score"] += np.take_along_axis(scores, best, 1).ravel().tolist()
        return pd.DataFrame(out)

    met = v.groupBy("a", "b").cogroup(q.groupBy("a", "b")).applyInPandas(near, f"query_id {types['query_id']}, id {types['id']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", "rank")


def contexts(hits: DataFrame, chunks: DataFrame, role: Column, id_col: str = "vec_id") -> DataFrame:
    """hits with their chunk's payload for a role; score rounded to four places. Ids without a chunk are dropped."""
    got = hits.join(for_role(chunks, role), hits[id_col] == chunks["clause_index"])
    return got.select(id_col, F.round("score", 4).alias("score"), "risk", "explanation", F.col("raw_clause").alias("clause"))


# The wording of a reference, and below of an answer without a model.
def context_text(risk: Column, why: Column, clause: Column, n: Column, role: Column) -> Column:
    """A retrieved clause as a numbered reference."""
    return F.concat(F.lit("[Reference "), n.cast("string"), F.lit("]\n  Risk for "), role, F.lit(": "), risk, F.lit("\n  Why: "), why, F.lit("\n  Clause text: "), snippet(clause, 300, dots=True))


def plain_answer(refs: Column, role: Column) -> Column:
    """The answer without a model: refs is an array of (risk, clause)."""
    lines = F.transform(refs, lambda r: F.concat(F.lit("• ["), r["risk"], F.lit(" for "), role, F.lit("] "), F.substring(r["clause"], 1, 120), F.lit("…")))
    # fixed values: the wording of the answer, but for its last sentence, which tells this library's own way
    some = F.concat(F.lit("Based on retrieved reference clauses (model not loaded):\n\n"), F.array_join(lines, "\n"), F.lit("\n\nRegister a generator for written answers."))
    return F.when(F.size(refs) > 0, some).otherwise("No relevant clauses found and model is not loaded.")
