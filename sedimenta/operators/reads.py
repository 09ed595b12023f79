"""Reading side of a mounted store: places, single reads of what many ask for, history, shapes, generated payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import running_total


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, from 0 in the order given; ranked by ranges and shifted, so no task sees all rows."""
    return running_total(rows, F.lit(1), order, "place")


def once(requests: DataFrame, key: list[str]) -> DataFrame:
    """Requests of one key made once, for all that wait on them."""
    return requests.dropDuplicates(key)


def history_mean(value: Column, by: list[str], order: list[str], width: int = 10, start: float = 0.5) -> Column:
    """The mean of the values of `width` rows before; `start` where there are none."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(-width, -1)
    return F.coalesce(F.avg(value).over(before), F.lit(start))


def gated(entropy: Column, history: Column, linear: Column) -> Column:
    """The linear prediction where the entropy is within 0.2 of its history, else the history; 1 above 0.95, less below
    0.3; between 0 and 1, and 0.5 where it is no number."""
    t = F.when(F.abs(entropy - history) > 0.2, history).otherwise(linear)
    t = F.when(entropy > 0.95, F.lit(1.0)).when(entropy < 0.3, t * 0.8).otherwise(t)
    return F.when(t.isNull() | F.isnan(t), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def shaped(values: Column, width: Column) -> Column:
    """The first `width` values, zeros behind them where there are fewer."""
    kept = F.slice(values, F.lit(1), F.least(F.size(values), width))
    return F.concat(kept, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), width - F.size(values))))


def payload(pattern: Column, size: Column) -> Column:
    """Bytes of zeros, or of a word repeated and cut."""
    word = F.when(pattern == "zeros", F.lit("\x00")).otherwise(F.lit("ABCD"))
    return F.encode(F.substring(F.repeat(word, size), F.lit(1), size), "UTF-8")


def result_order(results: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """A small table of results with each one's place by a column; ties by the first column."""
    first = F.desc(column) if descending else F.asc(column)
    return results.withColumn("place", F.row_number().over(Window.orderBy(first, results.columns[0])))
