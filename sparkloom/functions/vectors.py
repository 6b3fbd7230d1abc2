"""Vector scores as column expressions: doubles throughout, so that plans stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_WEIGHT, CODE_WEIGHT = 0.6, 0.4


def dot(a: Column, b: Column) -> Column:
    """The scalar product; 0 if the sizes differ, or either is empty or null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where the sizes differ, or either is empty, null or of norm 0."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.coalesce(n, F.lit(0.0)) > 0, dot(a, b) / n).otherwise(0.0)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector)).cast("array<double>")


def weighted_score(query: list[float]) -> Column:
    """Of an embeddings row: 0.6 of the summary's cosine and 0.4 of the code's, or the one there is; 0 for
    none, and for a query of norm 0. The query's norm is taken once, the rows' are stored columns."""
    size = math.sqrt(sum(float(x) * float(x) for x in query))
    if not size:
        return F.lit(0.0)
    usable = lambda v, n: F.col(v).isNotNull() & (F.coalesce(F.col(n), F.lit(0.0)) > 0)
    one = lambda v, n: dot(F.col(v), literal(query)) / (F.col(n) * size)
    summary, code = usable("summary_embedding", "summary_norm"), usable("code_embedding", "code_norm")
    s, c = one("summary_embedding", "summary_norm"), one("code_embedding", "code_norm")
    return F.when(summary & code, s * SUMMARY_WEIGHT + c * CODE_WEIGHT).when(summary, s).when(code, c).otherwise(0.0)


def with_norms(embeddings: DataFrame) -> DataFrame:
    return embeddings.withColumn("summary_norm", norm(F.col("summary_embedding"))).withColumn("code_norm", norm(F.col("code_embedding")))


def top_k(scored: DataFrame, k: int, key: str = "node_id") -> DataFrame:
    """The k best by score, ties by key: one heap a task, then one merge. None for k of 0 or less."""
    if k <= 0:
        return scored.limit(0)
    return scored.orderBy(F.desc("score"), key).limit(k)


def search(embeddings: DataFrame, query: list[float], k: int, ids: DataFrame | None = None) -> DataFrame:
    """node_id, text, score of the k best rows whose score is not 0; of the ids (column id) only, if given."""
    rows = embeddings if ids is None else embeddings.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    scored = rows.select("node_id", F.col("summary_text").alias("text"), weighted_score(query).alias("score"))
    return top_k(scored.filter("score <> 0"), k)
