"""Record validation, repair, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..sources.packed import unpacked
from .journal import COMMIT, COMPRESSED, DELETE, DIRECTORY, EXTENT, FILE, SYMLINK, has_flag


def violations(journal: DataFrame, extent_payload: int = 24) -> DataFrame:
    """(seq, path, rule): each rule that a record breaks. journal has data_len, the payload's length."""
    kind, size, data = F.col("type"), F.col("size"), F.col("data_len")
    rules = [
        (~paths.is_safe(F.col("path")), "unsafe path"),
        ((kind == DELETE) & (data > 0), "delete with data"),
        ((kind == DELETE) & (size != 0), "delete with size"),
        ((kind == DIRECTORY) & (data > 0), "directory with data"),
        ((kind == DIRECTORY) & (size != 0), "directory with size"),
        ((kind == COMMIT) & (data > 0), "commit with data"),
        ((kind == EXTENT) & (data != extent_payload), "extent payload"),
        ((kind == SYMLINK) & (data != size), "symlink size"),
        (~kind.between(1, 6), "unknown type"),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))
    return journal.select("seq", "path", F.explode(broken).alias("rule"))


def deep_violations(journal: DataFrame, blob_size: int | None = None) -> DataFrame:
    """(seq, path, rule) of what only the payloads show. journal has data. Compressed payloads are decoded, an error
    being that row's alone; extents are held against the blob's size."""
    kind, squeezed = F.col("type"), has_flag(COMPRESSED) & F.col("type").isin(FILE, SYMLINK)
    opened = journal.withColumn("deep", F.when(squeezed, unpacked(F.when(squeezed, F.col("data")))))
    real = F.octet_length(F.when(squeezed, F.col("deep.data")).otherwise(F.coalesce("data", F.lit(b""))))
    part = lambda k: _little_endian(F.substring("data", 8 * k + 1, 8))
    whole = (kind == EXTENT) & (F.octet_length("data") == 24)
    rules = [
        (squeezed & F.col("deep.error").isNotNull(), "payload cannot be decoded"),
        (kind.isin(FILE, SYMLINK) & (real != F.col("size")), "payload size"),
        (whole & F.lit(blob_size is None), "extent without blob"),
        (whole & (part(1) + part(2) > F.lit(blob_size or 0)) & F.lit(blob_size is not None), "extent beyond blob"),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))
    return opened.select("seq", "path", F.explode(broken).alias("rule"))


def _little_endian(data: Column) -> Column:
    """Eight bytes as an unsigned number, least first."""
    h = F.hex(data)
    return F.conv(F.concat(*[F.substring(h, 2 * k - 1, 2) for k in range(8, 0, -1)]), 16, 10).cast("decimal(20,0)")


def repair(journal: DataFrame) -> DataFrame:
    """(kept, dropped): records without and with violations."""
    bad = violations(journal).select("seq").distinct().withColumn("bad", F.lit(1))
    return journal.join(bad, "seq", "left").agg(F.sum(F.when(F.col("bad").isNull(), 1).otherwise(0)).alias("kept"), F.sum(F.coalesce("bad", F.lit(0))).alias("dropped"))


def flipped(data: Column, at: Column) -> Column:
    """The bytes with those of one place inverted."""
    byte = F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")
    other = F.unhex(F.lpad(F.hex(F.lit(255) - byte), 2, "0"))
    return F.concat(F.substring(data, F.lit(1), at), other, F.substring(data, at + 2, F.octet_length(data)))


def wrong_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks(data, crc32) whose decoded bytes have another checksum than is stored; those without one are passed over."""
    return chunks.where(F.col("crc32").isNotNull() & (F.crc32("data") != F.col("crc32")))


def repaired(journal: DataFrame) -> DataFrame:
    """The records without violations, as they are."""
    return journal.join(violations(journal).select("seq").distinct(), "seq", "left_anti")


def all_violations(journal: DataFrame, blob_size: int | None = None) -> DataFrame:
    """(seq, path, rule) of the shallow rules and of those that only the payloads show. journal has data."""
    lengths = journal.withColumn("data_len", F.octet_length(F.coalesce("data", F.lit(b""))))
    return violations(lengths).unionByName(deep_violations(journal, blob_size)).distinct()


def retention(df: DataFrame, by: str, newest: list, keep: int) -> DataFrame:
    """df with age_rank within `by`, and whether it is beyond the newest `keep`."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*newest))
    return df.withColumn("age_rank", rank).withColumn("expired", F.col("age_rank") > keep)
