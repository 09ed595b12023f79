"""Changes of a mounted store as journal records: what may be removed, changed attributes, renames, commits; compaction.

live(path, type, size) are the entries in force, as journal.overlay gives them. New records follow the journal's own in
version order; nothing is written in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .journal import COMMIT, DELETE, DIRECTORY, EXTENT, FILE, layout, rename
from .store import running_total

# File kinds within a mode, and the permissions of directories without a record.
S_IFREG, S_IFDIR, S_IFLNK = 0o100000, 0o040000, 0o120000
DIRECTORY_MODE, FILE_MODE, LINK_MODE = 0o755, 0o644, 0o777


def directories(live: DataFrame) -> DataFrame:
    """(path): every directory that has entries below it, and those with a record of their own."""
    above = live.select(F.explode(paths.ancestors(paths.parent(F.col("path")))).alias("path"))
    return above.unionByName(live.where(F.col("type") == DIRECTORY).select("path")).where("path != ''").distinct()


def attributes(live: DataFrame) -> DataFrame:
    """(path, kind, mode, nlink, size) of every entry and of the directories that only follow from entries below."""
    kind = F.when(F.col("type") == DIRECTORY, "directory").when(F.col("type") == 2, "symlink").otherwise("file")
    both = live.withColumn("kind", kind).select("path", "kind", "size").join(directories(live).withColumn("dir", F.lit(True)), "path", "full_outer")
    what = F.when(F.col("dir") & (F.coalesce("kind", F.lit("directory")) == "directory"), "directory").otherwise(F.col("kind"))
    mode = F.when(F.col("k") == "directory", S_IFDIR | DIRECTORY_MODE).when(F.col("k") == "symlink", S_IFLNK | LINK_MODE).otherwise(S_IFREG | FILE_MODE)
    out = both.withColumn("k", what)
    return out.select("path", F.col("k").alias("kind"), mode.alias("mode"), F.when(F.col("k") == "directory", 2).otherwise(1).alias("nlink"), F.when(F.col("k") == "directory", 0).otherwise(F.col("size")).cast("bigint").alias("size"))


def removal_errors(live: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(path, op) with error: that of `unlink` or `rmdir` on each, null where it may go."""
    known = attributes(live).select("path", "kind")
    full = live.select(F.explode(paths.ancestors(paths.parent(F.col("path")))).alias("path")).distinct().withColumn("has", F.lit(True))
    joined = requests.join(known, "path", "left").join(full, "path", "left")
    directory = F.col("kind") == "directory"
    unlink = F.when(directory, "EISDIR")
    rmdir = F.when(~directory, "ENOTDIR").when(F.col("has"), "ENOTEMPTY")
    return joined.select("path", "op", F.when(F.col("kind").isNull(), "ENOENT").when(F.col("op") == "unlink", unlink).otherwise(rmdir).alias("error"))


def appended(records: DataFrame, order: list[str], after: int) -> DataFrame:
    """records with seq: after the journal's last one, in the order given. Ranks run by ranges, not in one task."""
    return running_total(records, F.lit(1), order, "seq", after + 1)


def changed(live: DataFrame, mtime_ns: Column, mode: Column, after: int) -> DataFrame:
    """A full record again for each entry, with another mode or time."""
    return appended(live.select("path", "type", F.lit(0).alias("flags"), mtime_ns.alias("mtime_ns"), "size", mode.alias("mode")), ["path"], after)


def renamed(live: DataFrame, old: str, new: str, mtime_ns: Column, after: int) -> DataFrame:
    """The records of a rename: a copy of each entry at its new path, upper ones first, then a delete of each old path,
    lower ones first. A move into itself is refused."""
    moved = rename(live, old, new).join(live, "path")
    copies = moved.select(F.col("new_path").alias("path"), "type", "size", F.lit(0).alias("stage"), F.col("depth").alias("turn"))
    deletes = moved.select("path", F.lit(DELETE).alias("type"), F.lit(0).cast("bigint").alias("size"), F.lit(1).alias("stage"), (-F.col("depth")).alias("turn"))
    both = copies.unionByName(deletes).withColumn("mtime_ns", mtime_ns)
    return appended(both, ["stage", "turn", "path"], after).drop("turn", "stage")


def committed(files: DataFrame, inline_max: int, extent: int) -> DataFrame:
    """(path, ordinal, type, size, file_offset, raw_len) of the records that write files(path, size): one file record up
    to inline_max, else an extent each and a commit of the whole behind them."""
    parts = layout(files, inline_max, extent)
    inline = F.col("kind") == "inline"
    rows = parts.select("path", "ordinal", F.when(inline, FILE).otherwise(EXTENT).alias("type"), F.when(inline, F.col("raw_len")).otherwise(0).cast("bigint").alias("size"), "file_offset", "raw_len")
    n = F.ceil(F.col("size") / extent).cast("bigint")
    ends = files.where(F.col("size") > inline_max).select("path", n.alias("ordinal"), F.lit(COMMIT).alias("type"), F.col("size").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("file_offset"), F.lit(0).cast("bigint").alias("raw_len"))
    return rows.unionByName(ends)


def link_targets(entries: DataFrame) -> DataFrame:
    """(path, target, error) of reading each of entries(path, type, data) as a link."""
    link = F.col("type") == 2
    return entries.select("path", F.when(link, F.decode("data", "UTF-8")).alias("target"), F.when(~link, "EINVAL").alias("error"))


def compact(base: DataFrame, journal: DataFrame, folder: str) -> None:
    """Write the live entries as a new base, the journal without what it holds already, and the new watermark, each to
    its own place below folder. The base is written before the journal is cut, so a stop between leaves records that are
    applied again, to the same result."""
    from .journal import overlay, stats

    overlay(base, journal).select("path", "type", "size").write.parquet(f"{folder}/base")
    journal.agg(F.max("mtime_ns").alias("watermark"), F.count("*").alias("applied")).write.parquet(f"{folder}/watermark")
    journal.limit(0).write.parquet(f"{folder}/journal")
