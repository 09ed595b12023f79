"""Containers and change journals in their binary form, as Spark data sources: `chunk_container`, `change_journal`.

Files are opened through pyarrow's file systems, so a path may be local, shared or an object store's. A container is
read by ranges of its index, of any size; a journal has no index, so each journal file is one sequential scan. Writers
make one file for each task, whole or not at all: names become visible when the task's file is complete.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from ..functions import codec

# Magics and record layouts of the binary forms, little-endian.
CONTAINER_MAGIC, JOURNAL_MAGIC, VERSION = b"PSFS", b"PSFJ", 1
SUPERBLOCK = struct.Struct("<4sHHIIHBBIQQQQQQII4fB39s")
FILE_ENTRY = struct.Struct("<IHHIIQQQQII")
CHUNK_ENTRY = struct.Struct("<IIQIIQBBHI")
MANIFEST = struct.Struct("<B7s32s")
JOURNAL_HEADER = struct.Struct("<4sHHI")
RECORD = struct.Struct("<BBHIIIQQI")
CHUNK_RAW, CHUNK_CRC, CHUNK_LAST = 1, 2, 4
HAS_MANIFEST, SHA256 = 1, 2

BATCH_BYTES = 8 << 20
SCHEMAS = {
    "superblock": "container string, version int, flags bigint, chunk_size bigint, block_size int, codec_id int, hash_id int, file_count bigint, chunk_count bigint, index_offset bigint, strings_offset bigint, chunk_table_offset bigint, data_offset bigint, manifest_offset bigint, codec_flags bigint, seed bigint, weights array<float>, transform_id int",
    "files": "container string, file_id bigint, path string, mode int, flags int, uid bigint, gid bigint, mtime_ns bigint, size bigint, chunk_start bigint, chunk_count bigint",
    "chunks": "container string, file_id bigint, chunk_index bigint, flags bigint, file_offset bigint, raw_size bigint, stored_size bigint, data_offset bigint, codec_id int, transform_id int, crc32 bigint",
    "manifest": "container string, hash_id int, table_hash binary, matches boolean",
}
JOURNAL_SCHEMA = "journal string, seq bigint, offset bigint, type int, flags int, path string, mode bigint, uid bigint, gid bigint, mtime_ns bigint, size bigint, data_len bigint"


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, inner


def _files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder, without hidden and unfinished ones."""
    system, inner = _open(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = [i.base_name for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File]
    return [posixpath.join(path, n) for n in sorted(found) if n[0] not in "._"]


def _input(path: str):
    system, inner = _open(path)
    return system.open_input_file(inner)


def _exactly(source, offset: int, size: int) -> bytes:
    source.seek(offset)
    data = source.read(size)
    if len(data) != size:
        raise ValueError(f"{size} bytes expected at {offset}, {len(data)} found")
    return data


def read_superblock(source) -> dict:
    """The superblock's fields; a wrong magic, version or header size is refused."""
    f = SUPERBLOCK.unpack(_exactly(source, 0, SUPERBLOCK.size))
    if f[0] != CONTAINER_MAGIC or f[1] != VERSION or f[2] != SUPERBLOCK.size:
        raise ValueError("not a container of this version")
    names = ("flags", "chunk_size", "block_size", "codec_id", "hash_id", "file_count", "chunk_count", "index_offset", "strings_offset", "chunk_table_offset", "data_offset", "manifest_offset", "codec_flags", "seed")
    return {"version": f[1], **dict(zip(names, f[3:17], strict=True)), "weights": list(f[17:21]), "transform_id": f[21]}


def _batches(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


@dataclass
class EntryRange(InputPartition):
    path: str
    start: int
    stop: int


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.paths, self.table = _files_of(options["path"]), options.get("table", "files").lower()
        self.payload = options.get("payload", "false").lower() == "true"
        self.step = int(options.get("entriesperpartition", 200_000))
        self.schema, self.file_id = schema, None

    def pushFilters(self, filters):
        """An equality on file_id makes a point read; Spark still applies every filter."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file_id",) and self.table in ("files", "chunks"):
                self.file_id = f.value
            yield f

    def partitions(self):
        out = []
        for path in self.paths:
            with _input(path) as source:
                top = read_superblock(source)
                n = {"files": top["file_count"], "chunks": top["chunk_count"]}.get(self.table, 1)
                start = 0
                if self.file_id is not None:
                    start, n = self._point(source, top)
            out += [EntryRange(path, a, min(n, a + self.step)) for a in range(start, n, self.step)]
        return out or [EntryRange("", 0, 0)]

    def _point(self, source, top: dict) -> tuple[int, int]:
        k = self.file_id
        if not 0 <= k < top["file_count"]:
            return 0, 0
        if self.table == "files":
            return k, k + 1
        entry = FILE_ENTRY.unpack(_exactly(source, top["index_offset"] + k * FILE_ENTRY.size, FILE_ENTRY.size))
        return entry[7], entry[7] + entry[8]

    def read(self, partition: EntryRange):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.path:
            with _input(partition.path) as source:
                top = read_superblock(source)
                rows = getattr(self, "_" + self.table)(source, top, partition)
                yield from _batches(to_arrow_schema(self.schema), rows)

    def _superblock(self, source, top, part):
        yield (part.path, *top.values())

    def _manifest(self, source, top, part):
        """The stored hash, and whether index, strings and chunk table still have it; none where there is no manifest."""
        if top["flags"] & HAS_MANIFEST and top["manifest_offset"]:
            kind, _, stored = MANIFEST.unpack(_exactly(source, top["manifest_offset"], MANIFEST.size))
            digest = hashlib.sha256()
            at, end = top["index_offset"], top["data_offset"]
            while at < end:
                digest.update(_exactly(source, at, min(BATCH_BYTES, end - at)))
                at += BATCH_BYTES
            yield part.path, kind, stored, digest.digest() == stored

    def _files(self, source, top, part):
        entries = _exactly(source, top["index_offset"] + part.start * FILE_ENTRY.size, (part.stop - part.start) * FILE_ENTRY.size)
        rows = list(FILE_ENTRY.iter_unpack(entries))
        low, high = min(r[9] for r in rows), max(r[9] + r[10] for r in rows)
        if high > top["chunk_table_offset"] - top["strings_offset"]:
            raise ValueError("a path lies outside the string table")
        strings = _exactly(source, top["strings_offset"] + low, high - low)
        for i, mode, flags, uid, gid, mtime, size, start, count, at, length in rows:
            yield part.path, i, strings[at - low : at - low + length].decode("utf-8"), mode, flags, uid, gid, mtime, size, start, count

    def _chunks(self, source, top, part):
        entries = _exactly(source, top["chunk_table_offset"] + part.start * CHUNK_ENTRY.size, (part.stop - part.start) * CHUNK_ENTRY.size)
        for i, flags, offset, raw, stored, at, kind, name, _, crc in CHUNK_ENTRY.iter_unpack(entries):
            row = (part.path, i, offset // max(1, top["chunk_size"]), flags, offset, raw, stored, at, kind, name, crc)
            yield (*row, _exactly(source, at, stored)) if self.payload else row


@dataclass
class Written(WriterCommitMessage):
    names: list


class _TaskFileWriter(DataSourceWriter):
    """One file for each task, under a hidden name until the job commits."""

    suffix = ""

    def __init__(self, options: dict, schema) -> None:
        self.path, self.options, self.names, self.run = options["path"], options, schema.names, uuid.uuid4().hex

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.run}{self.suffix}"
        hidden = f".{name}.{task.taskAttemptId()}"
        system, inner = _open(self.path)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(posixpath.join(inner, hidden)) as out:
            n = self.write_file(out, rows)
        if n:
            return Written([(hidden, name)])
        system.delete_file(posixpath.join(inner, hidden))
        return Written([])

    def commit(self, messages) -> None:
        system, inner = _open(self.path)
        for m in messages:
            for hidden, name in m.names if m else ():
                system.move(posixpath.join(inner, hidden), posixpath.join(inner, name))

    def abort(self, messages) -> None:
        system, inner = _open(self.path)
        for m in messages:
            for hidden, _ in m.names if m else ():
                system.delete_file(posixpath.join(inner, hidden))


class ContainerWriter(_TaskFileWriter):
    """rows(path, data[, mode, flags, uid, gid, mtime_ns]): a container for each task, ids in the order of its rows.

    Options: chunkSize; codec `raw` or `coded`. A null data is an empty file. Payloads wait in the task's own temporary
    file, as tables stand before them."""

    suffix = ".psfs"

    def write_file(self, out, rows) -> int:
        size = int(self.options.get("chunksize", 512 * 1024))
        coded = self.options.get("codec", "raw") == "coded"
        index, strings, table, n_files, n_chunks, stored = bytearray(), bytearray(), [], 0, 0, 0
        with tempfile.TemporaryFile() as payloads:
            for row in rows:
                f = dict(zip(self.names, row))
                data, path = bytes(f["data"] or b""), f["path"].encode("utf-8")
                pieces = range(0, len(data), size)
                for k, at in enumerate(pieces):
                    raw = data[at : at + size]
                    kind, payload = codec.encode_chunk(raw, n_files, k) if coded else (1, raw)
                    flags = CHUNK_CRC | (CHUNK_RAW if kind else 0) | (CHUNK_LAST if k == len(pieces) - 1 else 0)
                    table.append((n_files, flags, at, len(raw), len(payload), stored, kind, 0, 0, zlib.crc32(raw)))
                    payloads.write(payload)
                    stored += len(payload)
                index += FILE_ENTRY.pack(n_files, (f.get("mode") or 0o644) & 0xFFFF, f.get("flags") or 0, f.get("uid") or 0, f.get("gid") or 0, f.get("mtime_ns") or 0, len(data), n_chunks, len(pieces), len(strings), len(path))
                strings += path
                n_files, n_chunks = n_files + 1, n_chunks + len(pieces)
            at_index = SUPERBLOCK.size
            at_strings = at_index + len(index)
            at_table = at_strings + len(strings)
            at_data = at_table + n_chunks * CHUNK_ENTRY.size
            chunks = b"".join(CHUNK_ENTRY.pack(*c[:5], c[5] + at_data, *c[6:]) for c in table)
            tables = bytes(index) + bytes(strings) + chunks
            head = (CONTAINER_MAGIC, VERSION, SUPERBLOCK.size, HAS_MANIFEST, size, codec.BLOCK, 0 if coded else 1, SHA256, n_files, n_chunks, at_index, at_strings, at_table, at_data, at_data + stored, 0, codec.SEED, *map(float, codec.WEIGHTS), 0, bytes(39))
            out.write(SUPERBLOCK.pack(*head))
            out.write(tables)
            payloads.seek(0)
            while block := payloads.read(BATCH_BYTES):
                out.write(block)
            out.write(MANIFEST.pack(SHA256, bytes(7), hashlib.sha256(tables).digest()))
        return n_files


class ContainerSource(DataSource):
    """Options: path (a container or a folder of them), table (superblock, files, chunks, manifest), payload (with
    chunks: their stored bytes), entriesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "chunk_container"

    def schema(self) -> str:
        table = self.options.get("table", "files").lower()
        return SCHEMAS[table] + (", payload binary" if table == "chunks" and self.options.get("payload", "false").lower() == "true" else "")

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(dict(self.options), schema)


class JournalReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.paths, self.schema = _files_of(options["path"]), schema
        self.data = options.get("payload", "false").lower() == "true"
        self.truncated = options.get("ontruncated", "report").lower()

    def partitions(self):
        return [EntryRange(p, 0, 0) for p in self.paths] or [EntryRange("", 0, 0)]

    def read(self, partition: EntryRange):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.path:
            with _input(partition.path) as source:
                yield from _batches(to_arrow_schema(self.schema), self._records(source, partition.path))

    def _records(self, source, path: str):
        end = source.size()
        head = _exactly(source, 0, JOURNAL_HEADER.size)
        if JOURNAL_HEADER.unpack(head)[:3] != (JOURNAL_MAGIC, VERSION, JOURNAL_HEADER.size):
            raise ValueError("not a journal of this version")
        at, seq = JOURNAL_HEADER.size, 0
        while at < end:
            cut, f = "header", None
            if at + RECORD.size <= end:
                f = RECORD.unpack(_exactly(source, at, RECORD.size))
                after = at + RECORD.size + f[2]
                cut = "path" if after > end else "data" if after + f[8] > end else None
            if cut:
                if self.truncated == "fail":
                    raise ValueError(f"journal ends within a record's {cut} at {at}")
                if self.truncated == "report":
                    yield (path, seq, at, *[None] * (9 + self.data), f"truncated {cut}")
                return
            name = source.read(f[2]).decode("utf-8", "replace")
            row = (path, seq, at, f[0], f[1], name, *f[3:9])
            yield (*row, _exactly(source, after, f[8]), None) if self.data else (*row, None)
            at, seq = after + f[8], seq + 1


class JournalWriter(_TaskFileWriter):
    """rows(type, path[, flags, mode, uid, gid, mtime_ns, size, data]): a journal file for each task, in the order of its
    rows; appending adds files. A size left out is that of the data."""

    suffix = ".psfj"

    def write_file(self, out, rows) -> int:
        out.write(JOURNAL_HEADER.pack(JOURNAL_MAGIC, VERSION, JOURNAL_HEADER.size, 0))
        n = 0
        for n, row in enumerate(rows, 1):
            f = dict(zip(self.names, row))
            path, data = (f["path"] or "").encode("utf-8"), bytes(f.get("data") or b"")
            size = len(data) if f.get("size") is None else f["size"]
            out.write(RECORD.pack(f["type"], f.get("flags") or 0, len(path), f.get("mode") or 0, f.get("uid") or 0, f.get("gid") or 0, f.get("mtime_ns") or 0, size, len(data)) + path + data)
        return n


class JournalSource(DataSource):
    """Options: path (a journal or a folder of them), payload (with the records' data), onTruncated: `report` (a row
    with corrupt set, the default), `stop` or `fail`."""

    @classmethod
    def name(cls) -> str:
        return "change_journal"

    def schema(self) -> str:
        return JOURNAL_SCHEMA + (", data binary" if self.options.get("payload", "false").lower() == "true" else "") + ", corrupt string"

    def reader(self, schema) -> JournalReader:
        return JournalReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> JournalWriter:
        return JournalWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Both sources by name; filters reach the container's reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerSource)
    spark.dataSource.register(JournalSource)
