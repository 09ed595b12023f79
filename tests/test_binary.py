"""Containers and journals in binary form: round trips, point reads, damage."""

import os
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sedimenta.functions import codec
from sedimenta.sources import binary


@pytest.fixture(scope="module")
def files():
    return [("a/empty", b""), ("a/one", b"x"), ("a/exact", bytes(range(64))), ("b/more", b"abcd" * 50 + b"z"), ("ü", "größer".encode() * 9)]


@pytest.mark.parametrize("kind", ["raw", "coded"])
def test_container_round_trip(spark, tmp_path, files, kind):
    binary.register(spark)
    where = str(tmp_path / "c")
    df = spark.createDataFrame(files, "path string, data binary").coalesce(1)
    df.write.format("chunk_container").option("chunkSize", 32).option("codec", kind).mode("append").save(where)
    assert len(os.listdir(where)) == 1
    read = spark.read.format("chunk_container").option("path", where).option("entriesPerPartition", 3)
    index = {r.path: r for r in read.load().collect()}
    assert {p: r.size for p, r in index.items()} == {p: len(d) for p, d in files}
    top = read.option("table", "superblock").load().first()
    assert (top.file_count, top.chunk_size) == (5, 32) and top.chunk_count == sum(-(-len(d) // 32) for _, d in files)
    assert read.option("table", "manifest").load().first().matches
    chunks = read.option("table", "chunks").option("payload", "true").load()
    decoded = chunks.withColumn("data", codec.decode_udf()("codec_id", "payload", "raw_size", "file_id", "chunk_index"))
    got: dict = {}
    for r in decoded.orderBy("file_id", "chunk_index").collect():
        assert zlib.crc32(r.data) == r.crc32
        got[r.file_id] = got.get(r.file_id, b"") + bytes(r.data)
    assert {p: got.get(r.file_id, b"") for p, r in index.items()} == dict(files)


def test_point_read(spark, tmp_path, files):
    binary.register(spark)
    where = str(tmp_path / "c")
    spark.createDataFrame(files, "path string, data binary").coalesce(1).write.format("chunk_container").option("chunkSize", 32).mode("append").save(where)
    read = spark.read.format("chunk_container").option("path", where)
    assert [r.path for r in read.load().where("file_id = 3").collect()] == ["b/more"]
    some = read.option("table", "chunks").load().where("file_id = 3").collect()
    assert [r.file_offset for r in some] == list(range(0, 201, 32))
    assert read.load().where("file_id = 99").count() == 0
    assert spark.read.format("chunk_container").option("path", where).load().where(F.col("size") > 1).count() == 3


def test_damaged_container(spark, tmp_path, files):
    binary.register(spark)
    where = str(tmp_path / "c")
    spark.createDataFrame(files, "path string, data binary").coalesce(1).write.format("chunk_container").mode("append").save(where)
    name = os.path.join(where, os.listdir(where)[0])
    data = bytearray(open(name, "rb").read())
    data[binary.SUPERBLOCK.size + 8] ^= 1
    open(name, "wb").write(data)
    assert not spark.read.format("chunk_container").option("path", name).option("table", "manifest").load().first().matches
    open(name, "wb").write(b"XXXX" + data[4:])
    with pytest.raises(PySparkException):
        spark.read.format("chunk_container").option("path", name).load().collect()


def test_journal_round_trip_and_truncation(spark, tmp_path):
    binary.register(spark)
    where = str(tmp_path / "j")
    rows = [(1, 0, "a", 5, b"hello"), (4, 2, "b", 6, None), (3, 0, "", 7, None)]
    spark.createDataFrame(rows, "type int, flags int, path string, mtime_ns bigint, data binary").coalesce(1).write.format("change_journal").mode("append").save(where)
    read = lambda path, **o: spark.read.format("change_journal").option("path", path).options(**o).load()
    got = read(where, payload="true").orderBy("seq").collect()
    assert [(r.type, r.flags, r.path, r.mtime_ns, bytes(r.data)) for r in got] == [(*r[:4], r[4] or b"") for r in rows]
    assert [r.corrupt for r in read(where).collect()] == [None] * 3 and "data" not in read(where).columns
    name = os.path.join(where, os.listdir(where)[0])
    whole = open(name, "rb").read()
    cut = str(tmp_path / "cut")
    for size, part, kept in ((len(whole) - 1, "header", 2), (binary.JOURNAL_HEADER.size + binary.RECORD.size + 3, "data", 0), (binary.JOURNAL_HEADER.size + binary.RECORD.size, "path", 0)):
        open(cut, "wb").write(whole[:size])
        got = read(cut).orderBy("seq").collect()
        assert [r.corrupt for r in got] == [None] * kept + [f"truncated {part}"]
        assert read(cut, onTruncated="stop").count() == kept
        with pytest.raises(PySparkException):
            read(cut, onTruncated="fail").collect()
