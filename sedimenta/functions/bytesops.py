"""Bytes of binary columns as arrays and rows; entropy, reversible transforms, 32-bit shifts. Counting bytes is an Arrow
kernel, as a row for each byte is beyond reason; all else is built-in functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSFORMS = {"none": 0, "delta": 1, "xor": 2, "evenodd": 3, "byteplane": 4}
ENTROPY_SKIP = 7.5


def byte_array(data: Column) -> Column:
    """The bytes of a binary column as ints. Elements are exploded alone, so no row carries its whole payload."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))


def byte_rows(df: DataFrame, key: str, data: Column) -> DataFrame:
    """(key, pos, b) for each byte."""
    return df.select(key, F.posexplode(byte_array(data)).alias("pos", "b"))


def _by_transform(data: np.ndarray, starts: np.ndarray, name: str) -> np.ndarray:
    """The bytes of consecutive payloads, each transformed for itself."""
    if name == "none":
        return data
    before = np.zeros_like(data)
    before[1:] = data[:-1]
    before[starts[starts < len(data)]] = 0
    return data - before if name == "delta" else data ^ before


def byte_counts(df: DataFrame, key: str, data: Column, transforms: tuple[str, ...] | None = None) -> DataFrame:
    """(key, b, n) for each byte value of each row; with transforms (none, delta, xor) also the transform's name.
    Null data are empty. Rows of one key are not yet added up."""
    rows = df.select(key, data.alias("data"))
    names = transforms or ("none",)
    spec = f"{key} {rows.schema[0].dataType.simpleString()}, {'transform string, ' * bool(transforms)}b int, n bigint"

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                column = batch.column(1).fill_null(b"")
                _, offsets, held = column.buffers()
                wide = pa.types.is_large_binary(column.type)
                at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                raw = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
                row = np.repeat(np.arange(len(column)), np.diff(at)) * 256
                for name in names:
                    counts = np.bincount(row + _by_transform(raw, at[:-1] - at[0], name), minlength=1)
                    found = np.flatnonzero(counts)
                    columns = [batch.column(0).take(pa.array(found // 256)), pa.array((found % 256).astype(np.int32)), pa.array(counts[found])]
                    if transforms:
                        columns.insert(1, pa.array([name] * len(found), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[key, *(["transform"] if transforms else []), "b", "n"])

    return rows.mapInArrow(run, spec)


def dense_histogram(spark, counts: DataFrame) -> DataFrame:
    """All 256 symbols with their count over counts(b, n), 0 where absent."""
    total = counts.groupBy("b").agg(F.sum("n").alias("n"))
    return spark.range(256).select(F.col("id").cast("int").alias("b")).join(total, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"))


def entropy(df: DataFrame, key: str, data: Column) -> DataFrame:
    """(key, n_bytes, entropy) for every row of df: bits a byte, 0 for empty data."""
    counts = byte_counts(df, key, data).groupBy(key, "b").agg(F.sum("n").alias("n"))
    per = counts.groupBy(key).agg(F.sum("n").alias("n_bytes"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    found = per.select(key, "n_bytes", (F.log2("n_bytes") - F.col("s") / F.col("n_bytes")).alias("entropy"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.greatest(F.coalesce("entropy", F.lit(0.0)), F.lit(0.0)).alias("entropy"))


def quantised(entropy_col: Column) -> Column:
    return F.floor(F.round(entropy_col * 100, 6)).cast("int")


def decision(entropy_col: Column, skip: float = ENTROPY_SKIP) -> Column:
    return F.when(entropy_col >= skip, "raw").otherwise("coded")


def shifted(arr: Column) -> Column:
    """The array one place later, beginning with 0."""
    return F.when(F.size(arr) > 0, F.concat(F.array(F.lit(0)), F.slice(arr, 1, F.size(arr) - 1))).otherwise(arr)


def delta_array(arr: Column) -> Column:
    return F.zip_with(arr, shifted(arr), lambda a, b: F.pmod(a - b, F.lit(256)))


def xor_array(arr: Column) -> Column:
    return F.zip_with(arr, shifted(arr), lambda a, b: a.bitwiseXOR(b))


def evenodd_array(arr: Column) -> Column:
    return F.concat(F.filter(arr, lambda x, i: i % 2 == 0), F.filter(arr, lambda x, i: i % 2 == 1))


def byteplane_array(arr: Column, stride: int = 4) -> Column:
    return F.concat(*[_plane(arr, stride, p) for p in range(stride)])


def _plane(arr: Column, stride: int, p: int) -> Column:
    return F.filter(arr, lambda x, i: i % stride == p)


def transformed(arr: Column, name: str) -> Column:
    """A transform by name; unknown names leave the array as it is."""
    return {"delta": delta_array, "xor": xor_array, "evenodd": evenodd_array, "byteplane": byteplane_array}.get(name, lambda x: x)(arr)


def evenodd_place(pos: Column, n: Column) -> Column:
    """Where evenodd puts the byte at pos of n."""
    return F.when(pos % 2 == 0, F.floor(pos / 2)).otherwise(F.ceil(n / 2) + F.floor(pos / 2)).cast("bigint")


def plane_place(pos: Column, n: Column, stride: int = 4) -> Column:
    """Where byte planes put the byte at pos of n; up to `stride` bytes stay as they are."""
    before = F.lit(0)
    for q in range(stride):
        before = before + F.when(pos % stride > q, F.ceil((n - q) / stride)).otherwise(0)
    return F.when(n <= stride, pos).otherwise(before + F.floor(pos / stride)).cast("bigint")


def xorshift32(x: Column) -> Column:
    """One step of the 32-bit generator (13, 17, 5) on a BIGINT."""
    mask = F.lit(0xFFFFFFFF)
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(mask)


def chunk_state(seed: int, file_id: Column, chunk: Column) -> Column:
    """The generator's state for a chunk: one step from seed ^ file_id * 0x9E3779B1 ^ chunk, in 32 bits."""
    mask = F.lit(0xFFFFFFFF)
    product = (file_id.bitwiseAND(F.lit(0x3FFFFFFF)) * F.lit(0x9E3779B1)).bitwiseAND(mask)
    return xorshift32(F.lit(seed).cast("bigint").bitwiseXOR(product).bitwiseXOR(chunk).bitwiseAND(mask))


def savings(original: Column, stored: Column) -> Column:
    """Percent saved, 0 for nothing."""
    return F.coalesce((1 - stored / F.nullif(original, F.lit(0))) * 100, F.lit(0.0))
