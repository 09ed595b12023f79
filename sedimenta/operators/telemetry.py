"""Smoothed symbol counts: every symbol starts at one. Prefix sums, frequencies, inverse lookup; all on 256 rows a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bytesops import dense_histogram


def model(spark, symbols: DataFrame) -> DataFrame:
    """(symbol, n, smoothed, cumulative, total) for all 256 symbols, from symbols(b)."""
    dense = dense_histogram(spark, symbols.groupBy("b").agg(F.count("*").alias("n")))
    up = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = dense.select(F.col("b").alias("symbol"), "n", (F.col("n") + 1).alias("smoothed"), (F.sum("n").over(Window.partitionBy()) + 256).alias("total"), F.sum(F.col("n") + 1).over(up).alias("cumulative"))
    return one.select("symbol", "n", "smoothed", "cumulative", "total")


def prefix_sum(symbols: DataFrame, up_to: int, by: list[str] | None = None) -> DataFrame:
    """Smoothed count of symbols up to up_to, one conditional sum and no window."""
    total = (F.sum(F.when(F.col("b") <= up_to, 1).otherwise(0)) + up_to + 1).alias("prefix_sum")
    return symbols.groupBy(*by).agg(total) if by else symbols.agg(total)


def frequency(spark, symbols: DataFrame) -> DataFrame:
    return model(spark, symbols).select("symbol", F.round(F.col("smoothed") / F.col("total"), 9).alias("frequency"))


def find_symbol(spark, symbols: DataFrame, quantiles: list[float]) -> DataFrame:
    """(quantile, symbol): the first symbol whose cumulative count is over that share of the total."""
    m = model(spark, symbols)
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles]))
    return m.select("*", q.alias("quantile")).where(F.col("cumulative") > F.floor(F.col("quantile") * F.col("total"))).groupBy("quantile").agg(F.min("symbol").alias("symbol"))
