"""Vector search and mock embeddings with array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bytesops import byte_array


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)


def mock_embedding(data: Column, width: int = 384) -> Column:
    """The first `width` bytes over 255, zeros behind, scaled to length one."""
    b = F.slice(byte_array(F.substring(data, 1, width)), 1, width)
    padded = F.concat(F.transform(b, lambda x: x / F.lit(255.0)), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(b)))
    return normalised(padded)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best vectors of each query. queries(query_id, query) is a stated set of
    bounded size and is broadcast; best-k of each task are kept before the shuffle (rank limit)."""
    scored = vectors.join(F.broadcast(queries)).select("query_id", "vec_id", F.round(dot(F.col("embedding"), F.col("query")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str, width: int) -> DataFrame:
    """(label, centroid) from one aggregate per dimension; combines before the shuffle."""
    return vectors.groupBy(label).agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(width)]).alias("centroid"))
