"""Folders and blobs: walking a folder, unpacking chunks to files, appending to blobs and reading their slices."""

from __future__ import annotations

import os
import posixpath
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions import paths
from ..operators.store import running_total
from .binary import BATCH_BYTES, _exactly, _input, _open


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime_ns, data) of every file below a folder that has bytes, paths relative to it. A file's bytes are
    read only where data is selected. Spark's reader leaves out empty files, directories and links: see `listing`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://", 1)[-1].rstrip("/") + "/"
    inner = F.regexp_replace("path", "^[a-z0-9+.-]+:/*", "/")
    return found.select(F.substring(inner, F.locate(root, inner) + len(root), F.length(inner)).alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("content").alias("data"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, size, mtime_ns) of all below a folder: kind is file, directory or symlink (local file systems only; a
    link is not followed). The driver lists the folder itself, tasks what is below its directories."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64())])

    def rows_of(system, base, found):
        for i in found:
            link = isinstance(system, fs.LocalFileSystem) and os.path.islink(i.path)
            kind = "symlink" if link else "directory" if i.type == fs.FileType.Directory else "file"
            size = len(os.readlink(i.path).encode()) if link else i.size or 0
            yield {"path": posixpath.relpath(i.path, base), "kind": kind, "size": size, "mtime_ns": i.mtime_ns or 0}

    def run(batches):
        system, base = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                todo = [posixpath.join(base, name)]
                while todo:
                    rows = list(rows_of(system, base, system.get_file_info(fs.FileSelector(todo.pop()))))
                    todo += [posixpath.join(base, r["path"]) for r in rows if r["kind"] == "directory"]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    system, base = _open(folder)
    top = list(rows_of(system, base, system.get_file_info(fs.FileSelector(base))))
    kind = "path string, kind string, size bigint, mtime_ns bigint"
    first = spark.createDataFrame([tuple(r.values()) for r in top], kind)
    inner = [(r["path"],) for r in top if r["kind"] == "directory"]
    below = spark.createDataFrame(inner, "path string").repartition(max(1, len(inner))).mapInArrow(run, kind)
    return first.unionByName(below)


def unpack(chunks: DataFrame, folder: str) -> DataFrame:
    """Write files below a folder all tasks can reach: (path, size) of each. chunks(path, chunk_index, data[, mode,
    mtime_ns]); a file without chunks comes as one row of null data.

    A file's chunks are sorted and written as they come, so none is held whole; it appears under its name when complete,
    and a task that runs again writes it again. Parts that lead upward are dropped from paths. Mode and time are set on
    local file systems."""
    extra = [c if c in chunks.columns else F.lit(None).cast("bigint").alias(c) for c in ("mode", "mtime_ns")]
    rows = chunks.select(paths.inside_only(F.col("path")).alias("path"), "chunk_index", "data", *extra).where("path != ''")
    schema = pa.schema([("path", pa.string()), ("size", pa.int64())])

    def finish(system, state):
        out, hidden, target, path, size, mode, mtime = state
        out.close()
        system.move(hidden, target)
        if isinstance(system, fs.LocalFileSystem):
            if mode is not None:
                os.chmod(target, mode & 0o7777)
            if mtime is not None:
                os.utime(target, ns=(mtime, mtime))
        return path, size

    def run(batches):
        system, base = _open(folder)
        state, done = None, []
        for batch in batches:
            for path, data, mode, mtime in zip(*(batch.column(c).to_pylist() for c in ("path", "data", "mode", "mtime_ns"))):
                if state and state[3] != path:
                    done.append(finish(system, state))
                    state = None
                if state is None:
                    target = posixpath.join(base, path)
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    hidden = posixpath.join(posixpath.dirname(target), f".{uuid.uuid4().hex}")
                    state = [system.open_output_stream(hidden), hidden, target, path, 0, mode, mtime]
                state[0].write(data or b"")
                state[4] += len(data or b"")
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema)
                done = []
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, finish(system, state)))], schema)

    return rows.repartition("path").sortWithinPartitions("path", "chunk_index").mapInArrow(run, "path string, size bigint")


def blob_offsets(rows: DataFrame, size: Column, order: list[str], start: int = 0) -> DataFrame:
    """rows with blob_offset, where each lands when all are appended in order to a blob that holds start bytes."""
    return running_total(rows, size, order, "blob_offset", start)


def blob_slices(slices: DataFrame) -> DataFrame:
    """slices(blob, blob_offset, stored_len, ...) with data; a slice beyond the blob's end is refused."""

    def run(batches):
        for batch in batches:
            names, held, start, found, size = [*batch.schema.names, "data"], {}, 0, [], 0
            try:
                for k, (blob, at, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("blob", "blob_offset", "stored_len")))):
                    if blob not in held:
                        held[blob] = _input(blob)
                    found.append(_exactly(held[blob], at, length))
                    size += length
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([*batch.slice(start, len(found)).columns, pa.array(found, pa.binary())], names=names)
                        start, found, size = k + 1, [], 0
            finally:
                for source in held.values():
                    source.close()
            if found:
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(found)).columns, pa.array(found, pa.binary())], names=names)

    kind = StructType([*slices.schema.fields, StructField("data", BinaryType())])
    return slices.mapInArrow(run, kind)
