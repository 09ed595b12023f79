"""Packed streams: a header, then chunks one after another until the end. As bytes, and as Spark data source
`packed_stream`. A stream has no index, so each one is a sequential scan; many streams are read side by side."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions import codec
from .binary import EntryRange, _batches, _exactly, _files_of, _input, _TaskFileWriter

# Magic, flags and layouts of the stream, big-endian, and the numbers of its transforms.
MAGIC, VERSION = b"PSP1", 4
HEADER = struct.Struct(">4sBBIHI4f")
CHUNK = struct.Struct(">IBH")
LENGTH = struct.Struct(">I")
RANKS, STORED_WEIGHTS, RAW_FILE, RAW_CHUNK = 1, 2, 32, 1
TRANSFORMS = ("none", "delta", "xor", "evenodd")
#: Bytes of chunks that are decoded side by side.
TOGETHER = 8 << 20

SCHEMAS = {
    "header": "stream string, version int, use_rank boolean, stored_weights boolean, transform string, force_raw boolean, chunk_size bigint, block_size int, seed bigint, weights array<float>",
    "chunks": "stream string, chunk_index bigint, raw_size bigint, codec_id int, entropy double, use_rank boolean, transform string, seed bigint, payload binary",
}


def read_header(source) -> dict:
    """The header's fields; a wrong magic or version, or an end within it, is refused."""
    magic, version, flags, chunk_size, block, seed, *weights = HEADER.unpack(_exactly(source, 0, HEADER.size))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a packed stream of this version")
    k = flags >> 2 & 7
    name = TRANSFORMS[k] if k < len(TRANSFORMS) else "none"
    return {"version": version, "use_rank": bool(flags & RANKS), "stored_weights": bool(flags & STORED_WEIGHTS), "transform": name, "force_raw": bool(flags & RAW_FILE), "chunk_size": chunk_size, "block_size": block, "seed": seed, "weights": weights}


def pack_into(out, pieces, chunk_size: int, transform: str = "none", ranks: bool = False, force_raw: bool = False) -> int:
    """Write the stream of the chunks that `pieces` yields; the number of chunks."""
    flags = (RANKS if ranks else 0) | STORED_WEIGHTS | TRANSFORMS.index(transform) << 2 | (RAW_FILE if force_raw else 0)
    out.write(HEADER.pack(MAGIC, VERSION, flags, chunk_size, codec.BLOCK, codec.SEED, *codec.WEIGHTS))
    n = 0
    for some in batched(pieces, 16):  # coded side by side
        if force_raw:
            out.write(b"".join(some))
        else:
            _write_chunks(out, some, codec.encode_chunks(list(some), [0] * len(some), list(range(n, n + len(some))), transform, ranks))
        n += len(some)
    return n


def _write_chunks(out, chunks, coded) -> None:
    for raw, (kind, payload) in zip(chunks, coded):
        out.write(CHUNK.pack(len(raw), RAW_CHUNK if kind else 0, int(codec.entropy_of(raw) * 100)))
        out.write(payload if kind else LENGTH.pack(len(payload)) + payload)


def pack_many(values: list[bytes], chunk_size: int = 512 * 1024, transform: str = "none") -> list[bytes]:
    """A stream of each value, the chunks of all coded side by side."""
    pieces = [[v[a : a + chunk_size] for a in range(0, len(v), chunk_size)] for v in values]
    coded = iter(codec.encode_chunks([c for p in pieces for c in p], [0] * sum(map(len, pieces)), [k for p in pieces for k in range(len(p))], transform))
    out = []
    for own in pieces:
        stream = io.BytesIO()
        stream.write(HEADER.pack(MAGIC, VERSION, STORED_WEIGHTS | TRANSFORMS.index(transform) << 2, chunk_size, codec.BLOCK, codec.SEED, *codec.WEIGHTS))
        _write_chunks(stream, own, [next(coded) for _ in own])
        out.append(stream.getvalue())
    return out


def pack(data: bytes, chunk_size: int = 512 * 1024, transform: str = "none", ranks: bool = False, force_raw: bool = False) -> bytes:
    out = io.BytesIO()
    pack_into(out, (data[a : a + chunk_size] for a in range(0, len(data), chunk_size)), chunk_size, transform, ranks, force_raw)
    return out.getvalue()


def chunks_of(source, top: dict) -> Iterator[tuple[int, int, int, float, bytes]]:
    """(chunk_index, raw_size, codec id, entropy, payload); an end within a chunk is refused."""
    at, end, k = HEADER.size, source.size(), 0
    while at < end:
        if top["force_raw"]:
            size = min(top["chunk_size"], end - at)
            raw = _exactly(source, at, size)
            yield k, size, 1, codec.entropy_of(raw), raw
            at += size
        else:
            size, flags, ent = CHUNK.unpack(_exactly(source, at, CHUNK.size))
            at, stored = at + CHUNK.size, size
            if not flags & RAW_CHUNK:
                stored = LENGTH.unpack(_exactly(source, at, LENGTH.size))[0]
                at += LENGTH.size
            yield k, size, 1 if flags & RAW_CHUNK else 0, ent / 100, _exactly(source, at, stored)
            at += stored
        k += 1


def unpack(data: bytes) -> bytes:
    source = pa.BufferReader(data)
    top = read_header(source)
    return b"".join(x for some in batched(chunks_of(source, top), 16) for x in _decoded(some, top["transform"], top["seed"]))


def _decoded(chunks, transform: str, seed: int) -> list[bytes]:
    index, sizes, kinds, _, payloads = (list(c) for c in zip(*chunks))
    return codec.decode_chunks(kinds, payloads, sizes, [0] * len(index), index, transform, seed)


def _each_decoded(chunks: list, transform: str, seed: int) -> list:
    """Data of each chunk, or the error that decoding it raises: chunks among which one fails are halved."""
    try:
        return _decoded(chunks, transform, seed)
    except Exception as e:  # a damaged payload may fail in any way
        if len(chunks) == 1:
            return [e]
        half = len(chunks) // 2
        return _each_decoded(chunks[:half], transform, seed) + _each_decoded(chunks[half:], transform, seed)


def unpack_many(values: list[bytes | None]) -> list[tuple[bytes | None, str | None]]:
    """(data, error) of each stream, the chunks of many decoded side by side; null gives two nulls. What cannot be
    decoded has a null data and the error's words, whatever the others are."""
    pieces: list[list] = [[] for _ in values]
    errors: dict[int, Exception] = {}
    waiting: dict[tuple, list] = {}  # by transform and seed: stream and chunk

    def decode(key):
        own = waiting.pop(key)
        for (i, _), data in zip(own, _each_decoded([c for _, c in own], *key)):
            if isinstance(data, Exception):
                errors.setdefault(i, data)
            else:
                pieces[i].append(data)

    held: dict[tuple, int] = {}
    for i, value in enumerate(values):
        if value is None:
            continue
        try:
            source = pa.BufferReader(value)
            top = read_header(source)
            key = top["transform"], top["seed"]
            for chunk in chunks_of(source, top):
                if i in errors:
                    break
                waiting.setdefault(key, []).append((i, chunk))
                held[key] = held.get(key, 0) + chunk[1]
                if held[key] >= TOGETHER:
                    held[key] = 0
                    decode(key)
        except Exception as e:  # as above
            errors.setdefault(i, e)
    for key in list(waiting):
        decode(key)
    failed = lambda i: f"{type(errors[i]).__name__}: {errors[i]}"
    return [(None, None) if v is None else (None, failed(i)) if i in errors else (b"".join(pieces[i]), None) for i, v in enumerate(values)]


def packed(data: Column, chunk_size: int = 512 * 1024, transform: str = "none") -> Column:
    """A binary column as packed streams; null stays null."""

    @F.pandas_udf("binary")
    def run(values):
        import pandas as pd

        made = iter(pack_many([bytes(v) for v in values if v is not None], chunk_size, transform))
        return pd.Series([None if v is None else next(made) for v in values], dtype=object)

    return run(data)


def unpacked(data: Column) -> Column:
    """(data, error) of a column of packed streams: what cannot be decoded has a null data and the error's words."""

    @F.pandas_udf("data binary, error string")
    def run(values):
        import pandas as pd

        return pd.DataFrame(unpack_many([None if v is None else bytes(v) for v in values]), columns=["data", "error"])

    return run(data)


def decoded(chunks: DataFrame) -> DataFrame:
    """stream, chunk_index and data of the source's chunks."""
    names = ("codec_id", "payload", "raw_size", "chunk_index", "transform", "seed")

    @F.pandas_udf("binary")
    def run(kind, payload, size, k, name, seed):
        import pandas as pd

        out = pd.Series([None] * len(kind), dtype=object)
        for (transform, key), own in kind.groupby([name, seed]).groups.items():
            at = list(own)
            out.loc[at] = codec.decode_chunks(kind[at].tolist(), [bytes(b) for b in payload[at]], size[at].tolist(), [0] * len(at), k[at].tolist(), transform, int(key))
        return out

    return chunks.select("stream", "chunk_index", run(*names).alias("data"))


class StreamReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.paths, self.schema, self.table = _files_of(options["path"]), schema, options.get("table", "chunks").lower()

    def partitions(self):
        return [EntryRange(p, 0, 0) for p in self.paths] or [EntryRange("", 0, 0)]

    def read(self, partition: EntryRange):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.path:
            with _input(partition.path) as source:
                top = read_header(source)
                if self.table == "header":
                    rows = iter([(partition.path, *top.values())])
                else:
                    more = top["use_rank"], top["transform"], top["seed"]
                    rows = ((partition.path, *c[:4], *more, c[4]) for c in chunks_of(source, top))
                yield from _batches(to_arrow_schema(self.schema), rows)


class StreamWriter(_TaskFileWriter):
    """rows(data): a stream for each task, of its rows' bytes in order, a chunk never spanning rows.

    Options: chunkSize, transform, ranks, forceRaw. Null data add nothing; a task without rows writes no file."""

    suffix = ".psp"

    def write_file(self, out, rows) -> int:
        size, n = int(self.options.get("chunksize", 512 * 1024)), 0

        def pieces():
            nonlocal n
            for row in rows:
                n += 1
                data = bytes(dict(zip(self.names, row))["data"] or b"")
                yield from (data[a : a + size] for a in range(0, len(data), size))

        on = lambda name: self.options.get(name, "false").lower() == "true"
        pack_into(out, pieces(), size, self.options.get("transform", "none"), on("ranks"), on("forceraw"))
        return n


class StreamSource(DataSource):
    """Options: path (a stream or a folder of them), table: `chunks` (the default) or `header`."""

    @classmethod
    def name(cls) -> str:
        return "packed_stream"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "chunks").lower()]

    def reader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StreamSource)
