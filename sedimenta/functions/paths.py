"""Store paths: relative, '' being the root. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO = ("mp4", "mkv", "mov", "avi", "webm")


def normalised(path: Column) -> Column:
    """Empty and '.' parts dropped, '..' resolved; leading '..' stay so that is_safe can refuse them."""
    relative = ~F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & ~relative, acc)
        .otherwise(F.array_append(acc, p)),
    )
    return F.array_join(folded, "/")


def is_safe(path: Column) -> Column:
    """No part of the path leads upward."""
    return ~(F.startswith(path, F.lit("..")) | F.contains(path, F.lit("/../")) | F.endswith(path, F.lit("/..")))


def inside_only(path: Column) -> Column:
    """Only normal parts kept, as an extractor does; '' where none is left."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".") & (p != "..")), "/")


def safe_target(target: Column) -> Column:
    """A symlink target that is neither absolute nor leads upward."""
    return ~F.startswith(target, F.lit("/")) & ~F.array_contains(F.split(target, "/"), "..")


def ancestors(path: Column) -> Column:
    """The path itself, each directory above it, and '' the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def under(path: Column, directory: Column) -> Column:
    """The path is the directory, or in it; all are in the root."""
    return (directory == "") | (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def moved(path: Column, old: Column, new: Column) -> Column:
    return F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))


def blob_path(journal: Column) -> Column:
    return F.when(F.endswith(journal, F.lit(".psfj")), F.concat(F.substring(journal, F.lit(1), F.length(journal) - 5), F.lit(".psfb"))).otherwise(F.concat(journal, F.lit(".psfb")))


def is_video(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./]+)$", 1).isin(*VIDEO)
