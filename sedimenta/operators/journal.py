"""The change journal: version order (mtime_ns, seq), latest record wins, recursive deletes, extents and commits.

journal(seq, type, flags, path, mtime_ns, size): type 1 file, 2 symlink, 3 directory, 4 delete, 5 extent, 6 commit;
flag 2 is a recursive delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths

FILE, SYMLINK, DIRECTORY, DELETE, EXTENT, COMMIT = range(1, 7)
COMPRESSED, RECURSIVE = 1, 2


def has_flag(flag: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(flag)) != 0


def stats(journal: DataFrame) -> DataFrame:
    """records, min and max mtime (0 if none) and the path of the largest version."""
    return journal.agg(
        F.count("*").alias("records"),
        F.coalesce(F.min("mtime_ns"), F.lit(0)).alias("min_mtime_ns"),
        F.coalesce(F.max("mtime_ns"), F.lit(0)).alias("max_mtime_ns"),
        F.max_by("path", F.struct("mtime_ns", "seq")).alias("last_path"),
    )


def since(journal: DataFrame, watermark: int) -> DataFrame:
    """Records from the watermark on, inclusive; the predicate reaches the scan."""
    return journal.where(F.col("mtime_ns") >= watermark)


def latest(journal: DataFrame) -> DataFrame:
    """The winning record of each path. An aggregate of structs, so it combines before the shuffle."""
    version = F.max(F.struct("mtime_ns", "seq", "type", "flags", "size")).alias("v")
    return journal.where(F.col("type") != EXTENT).groupBy("path").agg(version).select("path", "v.*")


def recursive_deletes(journal: DataFrame) -> DataFrame:
    """(directory, del_mtime, del_seq): the last recursive delete of each directory."""
    rows = journal.where((F.col("type") == DELETE) & has_flag(RECURSIVE))
    return rows.groupBy(F.col("path").alias("directory")).agg(F.max(F.struct(F.col("mtime_ns").alias("del_mtime"), F.col("seq").alias("del_seq"))).alias("d")).select("directory", "d.*")


def masked(rows: DataFrame, journal: DataFrame, key: list[str]) -> DataFrame:
    """rows(path, mtime_ns, seq, ...) that a later recursive delete of a directory above hides, or that have no version.

    A prefix join would compare all with all; every path is sent to its own ancestors instead and joined by equality."""
    each = rows.select(*key, "mtime_ns", "seq", F.explode(paths.ancestors(F.col("path"))).alias("directory"))
    hit = each.join(recursive_deletes(journal), "directory").where(F.col("mtime_ns").isNull() | (F.struct("del_mtime", "del_seq") > F.struct("mtime_ns", "seq")))
    return hit.select(*key).distinct()


def overlay(base: DataFrame, journal: DataFrame) -> DataFrame:
    """Live entries: path, type, size, origin. base(path, size) loses to any record of its path; the newest record wins;
    deleted and hidden ones are absent."""
    won = latest(journal).select("path", "mtime_ns", "seq", "type", F.col("size").alias("j_size"))
    both = base.select("path", F.col("size").alias("b_size"), F.lit(True).alias("in_base")).join(won, "path", "full_outer")
    hidden = masked(both, journal, ["path"])
    live = both.where(F.col("type").isNull() | (F.col("type") != DELETE)).join(hidden, "path", "left_anti")
    return live.select("path", F.coalesce("type", F.lit(FILE)).alias("type"), F.coalesce("j_size", "b_size").alias("size"), F.when(F.col("type").isNull(), "base").otherwise("journal").alias("origin"))


def conflicts(journal: DataFrame) -> DataFrame:
    """Paths with several records other than extents, and the winner's type."""
    rows = journal.where(F.col("type") != EXTENT).groupBy("path")
    return rows.agg(F.count("*").alias("records"), F.max_by("type", F.struct("mtime_ns", "seq")).alias("winner_type"), F.min("seq").alias("first_seq")).where("records > 1")


def epochs(journal: DataFrame) -> DataFrame:
    """journal with epoch: how many commits and resets of the path come before. Extents belong to the record that ends
    their epoch; one path's records meet in a task, as its writer made them."""
    order = Window.partitionBy("path").orderBy("mtime_ns", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return journal.withColumn("epoch", F.coalesce(F.sum(F.when(F.col("type") != EXTENT, 1).otherwise(0)).over(order), F.lit(0)))


def committed_extents(journal: DataFrame) -> DataFrame:
    """Extents whose epoch ends with a commit, cut at the commit's size."""
    e = epochs(journal)
    ends = e.where(F.col("type") == COMMIT).select("path", "epoch", F.col("size").alias("commit_size"), F.col("seq").alias("commit_seq"))
    extents = e.where(F.col("type") == EXTENT).select("path", "epoch", "seq", "file_offset", "raw_len")
    cut = F.greatest(F.least(F.col("raw_len"), F.col("commit_size") - F.col("file_offset")), F.lit(0))
    return extents.join(ends, ["path", "epoch"]).withColumn("visible_len", cut)


def overlapping(extents: DataFrame, offset: int, length: int) -> DataFrame:
    """Extents that meet [offset, offset + length), with the part of them that does."""
    end = F.col("file_offset") + F.col("raw_len")
    hit = extents.where((end > offset) & (F.col("file_offset") < offset + length))
    return hit.withColumn("from", F.greatest(F.col("file_offset"), F.lit(offset))).withColumn("upto", F.least(end, F.lit(offset + length)))


def layout(files: DataFrame, inline_max: int, extent: int) -> DataFrame:
    """(path, kind, ordinal, file_offset, raw_len): one inline record up to inline_max, else extents."""
    n = F.when(F.col("size") <= inline_max, F.lit(1).cast("bigint")).otherwise(F.ceil(F.col("size") / extent).cast("bigint"))
    each = files.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    inline = F.col("size") <= inline_max
    offset = F.when(inline, F.lit(0)).otherwise(F.col("ordinal") * extent)
    return each.select("path", F.when(inline, "inline").otherwise("extent").alias("kind"), "ordinal", offset.cast("bigint").alias("file_offset"), F.when(inline, F.col("size")).otherwise(F.least(F.lit(extent), F.col("size") - offset)).cast("bigint").alias("raw_len"))


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, new_path, depth) of a subtree that moves; into itself is refused."""
    if new == old or new.startswith(old + "/"):
        raise ValueError("a directory cannot move into itself")
    hit = files.where(paths.under(F.col("path"), F.lit(old)))
    return hit.select("path", paths.moved(F.col("path"), F.lit(old), F.lit(new)).alias("new_path"), paths.depth(F.col("path")).alias("depth"))


def increment(journal: DataFrame, watermark: int) -> DataFrame:
    """What one compaction run applies: records from the watermark on, as one row of count, new watermark and digest."""
    return since(journal, watermark).agg(F.count("*").alias("applied"), F.coalesce(F.max("mtime_ns"), F.lit(watermark)).alias("watermark"), F.coalesce(F.sum("seq"), F.lit(0)).alias("seq_sum"))


def keep_compressed(raw: Column, stored: Column, min_size: int | Column, min_gain: int | Column) -> Column:
    return (raw >= min_size) & (stored + min_gain < raw)
