"""Packed streams, folders and blobs: round trips, damage, deep checks."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sedimenta.operators import checks, store
from sedimenta.plans import benchmarks
from sedimenta.sources import folders, packed

TEXTS = [b"", b"x", b"ab" * 300, bytes(range(256)) * 3, "größer ".encode() * 50, random.Random(5).randbytes(900)]


@pytest.mark.parametrize("data", TEXTS)
@pytest.mark.parametrize("raw", [False, True])
def test_bytes_round_trip(data, raw):
    for transform in packed.TRANSFORMS:
        for ranks in (False, True):
            assert packed.unpack(packed.pack(data, 256, transform, ranks, raw)) == data


def test_source_round_trip(spark, tmp_path):
    packed.register(spark)
    where = str(tmp_path / "s")
    spark.createDataFrame([(t,) for t in TEXTS], "data binary").coalesce(1).write.format("packed_stream").option("chunkSize", 128).option("transform", "xor").mode("append").save(where)
    read = spark.read.format("packed_stream").option("path", where)
    rows = packed.decoded(read.load()).orderBy("chunk_index").collect()
    assert b"".join(bytes(r.data) for r in rows) == b"".join(TEXTS)
    top = read.option("table", "header").load().first()
    assert (top.chunk_size, top.transform, top.force_raw, top.version) == (128, "xor", False, 4)
    name = os.path.join(where, os.listdir(where)[0])
    whole = open(name, "rb").read()
    open(name, "wb").write(whole[:-1])
    with pytest.raises(PySparkException):
        spark.read.format("packed_stream").option("path", where).load().collect()


def test_columns_are_unpacked_side_by_side(spark, monkeypatch):
    """Streams of a column share the decoder's passes: a pass for each of them took minutes for a thousand texts. A
    damaged one fails alone."""
    rng = random.Random(8)
    texts = [bytes(rng.choices(b"abcde", k=rng.randrange(700))) for _ in range(60)]
    made = [packed.pack(t, 256, packed.TRANSFORMS[i % 2]) for i, t in enumerate(texts)]
    bad, chunk = made[5][:-2], packed.HEADER.size + packed.CHUNK.size
    worse = made[7][:chunk] + (3).to_bytes(4, "big") + made[7][chunk + 4 :]
    values = [*made, None, bad, b"", worse, packed.pack(b"")]
    for together in (packed.TOGETHER, 300):
        monkeypatch.setattr(packed, "TOGETHER", together)
        passes, real = [], packed.codec.range_decode
        monkeypatch.setattr(packed.codec, "range_decode", lambda parts, sizes: passes.append(len(parts)) or real(parts, sizes))
        got = packed.unpack_many(values)
        monkeypatch.setattr(packed.codec, "range_decode", real)
        assert got[:61] == [*((t, None) for t in texts), (None, None)] and got[64] == (b"", None)
        assert all(data is None and ": " in error for data, error in got[61:64])
        if together > 300:
            assert len(passes) < 20
    rows = spark.createDataFrame(list(enumerate(values)), "k bigint, v binary").select("k", packed.unpacked(F.col("v")).alias("u")).collect()
    assert {r.k: (r.u.data if r.u.data is None else bytes(r.u.data), r.u.error) for r in rows} == dict(enumerate(got))


def test_deep_checks(spark):
    good = packed.pack(b"hello" * 40, 64)
    extent = lambda at, n: (0).to_bytes(8, "little") + at.to_bytes(8, "little") + n.to_bytes(8, "little")
    rows = [(0, 1, 1, 200, good), (1, 1, 1, 199, good), (2, 1, 1, 200, good[:-3]), (3, 1, 0, 5, b"hello"), (4, 2, 0, 5, b"hell"), (5, 5, 0, 9, extent(90, 10)), (6, 5, 0, 9, extent(90, 11)), (7, 1, 1, 0, None), (8, 4, 0, 0, None), (9, 5, 0, 9, extent((1 << 63) + 5, 1))]
    j = spark.createDataFrame(rows, "seq bigint, type int, flags int, size bigint, data binary").withColumn("path", F.lit("p"))
    got = sorted((r.seq, r.rule) for r in checks.deep_violations(j, 100).collect())
    assert got == [(1, "payload size"), (2, "payload cannot be decoded"), (4, "payload size"), (6, "extent beyond blob"), (9, "extent beyond blob")]
    assert {r.seq for r in checks.deep_violations(j).where("rule = 'extent without blob'").collect()} == {5, 6, 9}


def test_walk_and_unpack(spark, tmp_path):
    files = [("a/empty", b""), ("a/b/more", bytes(range(250)) * 7), ("../../up", b"kept inside"), ("ü.txt", b"x")]
    df = spark.createDataFrame(files, "path string, data binary")
    chunks = store.chunk_data(df, "path", F.col("data"), 100).select("path", "chunk_index", "data")
    empty = df.where(F.octet_length("data") == 0).select("path", F.lit(0).cast("bigint").alias("chunk_index"), F.lit(None).cast("binary").alias("data"))
    folder = str(tmp_path / "out")
    made = {r.path: r.size for r in folders.unpack(chunks.unionByName(empty).withColumn("mode", F.lit(0o600)).withColumn("mtime_ns", F.lit(1_000_000_000)), folder).collect()}
    want = {"a/empty": b"", "a/b/more": files[1][1], "up": b"kept inside", "ü.txt": b"x"}
    assert made == {k: len(v) for k, v in want.items()}
    got = {r.path: r for r in folders.walk(spark, folder).collect()}
    assert {k: bytes(r.data) for k, r in got.items()} == {k: v for k, v in want.items() if v} and all(r.mtime_ns == 1_000_000_000 for r in got.values())
    os.makedirs(os.path.join(folder, "a/none"))
    os.symlink("b/more", os.path.join(folder, "a/link"))
    kinds = {r.path: (r.kind, r["size"]) for r in folders.listing(spark, folder).collect()}
    assert {p for p, k in kinds.items() if k[0] == "directory"} == {"a", "a/b", "a/none"} and kinds["a/link"] == ("symlink", 6)
    assert {p: k[1] for p, k in kinds.items() if k[0] == "file"} == {k: len(v) for k, v in want.items()}
    assert os.stat(os.path.join(folder, "a/b/more")).st_mode & 0o777 == 0o600


def test_blobs(spark, tmp_path):
    rng = random.Random(3)
    parts = [rng.randbytes(rng.randrange(50)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(parts)), "k bigint, data binary").repartition(5)
    placed = {r.k: r.blob_offset for r in folders.blob_offsets(df, F.octet_length("data"), ["k"], start=4).collect()}
    blob = b"head" + b"".join(parts)
    assert all(blob[placed[k] : placed[k] + len(p)] == p for k, p in enumerate(parts))
    name = str(tmp_path / "x.psfb")
    open(name, "wb").write(blob)
    slices = spark.createDataFrame([(k, name, placed[k], len(p)) for k, p in enumerate(parts)], "k bigint, blob string, blob_offset bigint, stored_len bigint")
    assert {r.k: bytes(r.data) for r in folders.blob_slices(slices).collect()} == dict(enumerate(parts))
    with pytest.raises(PySparkException):
        folders.blob_slices(spark.createDataFrame([(name, len(blob) - 1, 2)], "blob string, blob_offset bigint, stored_len bigint")).collect()


def test_write_and_truncate(spark):
    cases = [(b"hello", 3, b"XY"), (b"hello", 8, b"Z"), (b"", 0, b"a"), (b"hello", 0, b""), (b"hello", 1, b"longer than it was")]
    df = spark.createDataFrame(cases, "data binary, at int, patch binary")
    got = df.select(store.written(F.col("data"), F.col("at"), F.col("patch")).alias("w"), store.truncated(F.col("data"), F.col("at")).alias("t"), "data", "at", "patch").collect()
    for r in got:
        old, at, patch = bytes(r.data), r["at"], bytes(r.patch)
        assert bytes(r.w) == old[:at].ljust(at, b"\0") + patch + old[at + len(patch) :]
        assert bytes(r.t) == old[:at].ljust(at, b"\0")


def test_truncate_chunks(spark):
    files = {"a": b"abcdefghij", "b": b"abcdefghij", "c": b"abc", "d": b"stays as it is", "e": b"gone"}
    df = spark.createDataFrame(list(files.items()), "path string, data binary")
    chunks = store.chunk_data(df, "path", F.col("data"), 4)
    lengths = spark.createDataFrame([("a", 6), ("b", 8), ("c", 11), ("e", 0)], "path string, length bigint")
    out = store.truncate_chunks(chunks, lengths, "path", 4)
    assert all(len(r.data) <= 4 for r in out.collect())
    got = {r.path: bytes(r.data) for r in store.reassemble(out, "path").collect()}
    assert got == {"a": b"abcdef", "b": b"abcdefgh", "c": b"abc" + bytes(8), "d": files["d"]}


def test_tools_and_variants_restore(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "data binary")
    rows = benchmarks.compare(df, [*benchmarks.TOOLS, *benchmarks.OWN]).collect()
    assert len(rows) == 13 and all(r.ok and r.chunks == len(TEXTS) and r.orig == sum(map(len, TEXTS)) for r in rows)
    assert benchmarks.compare(df.limit(0), list(benchmarks.TOOLS)).count() == 0
