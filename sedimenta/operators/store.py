"""The chunk store as DataFrames: file index, chunk table, range reads, reassembly, fragments, directory edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from .shared import checkpoint

CHUNK = 512 * 1024


def exclusive_sum(value: str, order: list, by: list | None = None) -> Column:
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows range-partitioned by order, with the range's number as __part. Written out: what is summed by range and what
    is shifted by it must see the same ranges, and a range cut anew may fall elsewhere."""
    return checkpoint(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def running_total(rows: DataFrame, size: Column, order: list[str], name: str, start: int = 0) -> DataFrame:
    """rows with `name`: start and the sizes of all rows before, in the order given. Sums run within ranges and are
    shifted by the ranges' totals, a row for each range."""
    ranged = in_ranges(rows.withColumn("__size", size.cast("bigint")), order)
    totals = ranged.groupBy("__part").agg(F.sum("__size").alias("__t"))
    shift = totals.select("__part", (exclusive_sum("__t", ["__part"]) + start).alias("__shift"))
    inside = ranged.withColumn("__inside", exclusive_sum("__size", order, ["__part"]))
    out = inside.join(F.broadcast(shift), "__part")
    return out.select(*rows.columns, (F.col("__shift") + F.col("__inside")).cast("bigint").alias(name))


def file_index(files: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """files(path, size) with file_id in path order, chunk_count and chunk_start.

    Ids are global ranks: paths are range-partitioned, ranked within each range, and shifted by the ranges' totals."""
    counted = in_ranges(files, ["path"]).withColumn("chunk_count", F.ceil(F.col("size") / chunk_size).cast("bigint"))
    totals = counted.groupBy("__part").agg(F.count("*").alias("n"), F.sum("chunk_count").alias("c"))
    shift = totals.select("__part", exclusive_sum("n", ["__part"]).alias("files_before"), exclusive_sum("c", ["__part"]).alias("chunks_before"))
    inside = Window.partitionBy("__part").orderBy("path")
    ranked = counted.withColumn("k", F.row_number().over(inside) - 1).withColumn("s", exclusive_sum("chunk_count", ["path"], ["__part"]))
    out = ranked.join(F.broadcast(shift), "__part")  # a row for each range
    return out.select((F.col("files_before") + F.col("k")).cast("bigint").alias("file_id"), "path", "size", (F.col("chunks_before") + F.col("s")).cast("bigint").alias("chunk_start"), "chunk_count")


def chunk_rows(files: DataFrame, key: str, size: Column, chunk_size: int = CHUNK) -> DataFrame:
    """(key, chunk_index, file_offset, raw_size): one row a chunk, none for an empty file; a huge file is many rows."""
    n = F.ceil(F.col("size") / chunk_size).cast("bigint")
    each = files.withColumn("size", size).where("size > 0").withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    offset = F.col("chunk_index") * chunk_size
    return each.withColumn("file_offset", offset).withColumn("raw_size", F.least(F.lit(chunk_size).cast("bigint"), F.col("size") - offset))


def chunk_data(files: DataFrame, key: str, data: Column, chunk_size: int = CHUNK) -> DataFrame:
    """chunk_rows with the chunk's bytes, for (key, data) files. The pieces are cut before they are exploded."""
    n = F.ceil(F.octet_length(data) / chunk_size).cast("int")
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * chunk_size + 1, F.lit(chunk_size))))
    out = files.select(key, F.posexplode(pieces).alias("chunk_index", "data"))
    return out.select(key, F.col("chunk_index").cast("bigint").alias("chunk_index"), (F.col("chunk_index").cast("bigint") * chunk_size).alias("file_offset"), F.octet_length("data").cast("bigint").alias("raw_size"), "data")


def read_range(chunks: DataFrame, key: str, offset: int, length: int, chunk_size: int) -> DataFrame:
    """(key, data): bytes [offset, offset + length) of each file, from the chunks that hold them only."""
    first, last = offset // chunk_size, (offset + length - 1) // chunk_size
    some = chunks.where(F.col("chunk_index").between(first, last))
    start = F.greatest(F.lit(offset) - F.col("file_offset"), F.lit(0)).cast("int")
    stop = F.least(F.lit(offset + length) - F.col("file_offset"), F.col("raw_size")).cast("int")
    return reassemble(some.withColumn("data", F.substring("data", start + 1, F.greatest(stop - start, F.lit(0)))), key)


def reassemble(chunks: DataFrame, key: str) -> DataFrame:
    """(key, data): chunks put together in order. What one file holds meets in one row, as its reader asks for."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "data")))
    parts = F.transform(ordered, lambda x: F.hex(x["data"]))
    return chunks.groupBy(key).agg(F.unhex(F.array_join(parts, "")).alias("data"))


def fragments(files: DataFrame, key: str, size: Column, fragment: int = 16 * 1024) -> DataFrame:
    """(key, fragment, offset, length, is_last) of a stream cut for sending."""
    rows = chunk_rows(files, key, size, fragment)
    return rows.select(key, F.col("chunk_index").alias("fragment"), F.col("file_offset").alias("offset"), F.col("raw_size").alias("length"), (F.col("file_offset") + F.col("raw_size") >= F.col("size")).alias("is_last"))


def edges(paths_df: DataFrame) -> DataFrame:
    """Distinct (parent, child) of every path and every directory above it, up to the root ''."""
    each = paths_df.select(F.explode(paths.ancestors(F.col("path"))).alias("child")).where("child != ''").distinct()
    return each.select(paths.parent(F.col("child")).alias("parent"), "child")


def manifest_hash(df: DataFrame, order: str, fields: list[str], fan: int = 4096) -> DataFrame:
    """(table_hash): the root of a hash tree. Leaves are the SHA-256 of rows; those whose order has the same quotient by
    fan are hashed together, then those of the same quotient by fan * fan, then the rest, which at 2^36 rows is 4,096 digests.
    `order` is a dense number, so no task holds more than fan digests below the root."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)
    level = df.select(F.col(order).alias("o"), row.alias("r"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]), ""), 256)
    for _ in range(2):
        level = level.groupBy(F.floor(F.col("o") / fan).alias("up")).agg(joined.alias("r")).withColumnRenamed("up", "o")
    return level.agg(joined.alias("table_hash"))


def truncated(data: Column, length: Column) -> Column:
    """The first `length` bytes; zeros follow where there are fewer."""
    return F.rpad(F.substring(data, F.lit(1), length.cast("int")), length.cast("int"), F.lit(b"\x00"))


def written(data: Column, offset: Column, patch: Column) -> Column:
    """data with patch laid over it from offset on; a gap before it is filled with zeros, the rest of data stays."""
    after = offset + F.octet_length(patch)
    return F.concat(truncated(data, offset), patch, F.substring(data, (after + 1).cast("int"), F.greatest(F.octet_length(data) - after, F.lit(0)).cast("int")))


def truncate_chunks(chunks: DataFrame, lengths: DataFrame, key: str, chunk_size: int) -> DataFrame:
    """chunks(key, chunk_index, data) of files cut or extended with zeros to lengths(key, length). Chunks that lie before
    the end in full are not rewritten, those behind it are dropped, and files not named in lengths stay as they are."""
    n = F.ceil(F.col("length") / chunk_size).cast("bigint")
    slots = lengths.select(key, "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, F.lit(1)) - 1)).alias("chunk_index")).where("length > 0")
    size = F.least(F.lit(chunk_size).cast("bigint"), F.col("length") - F.col("chunk_index") * chunk_size)
    held = chunks.select(key, "chunk_index", "data")
    changed = slots.join(held, [key, "chunk_index"], "left").select(key, "chunk_index", truncated(F.coalesce("data", F.lit(b"")), size).alias("data"))
    return held.join(lengths.select(key), key, "left_anti").unionByName(changed)
