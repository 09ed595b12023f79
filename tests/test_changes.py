"""Settings, changes as records, compaction, streams of several batches."""

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import checks, journal as J, mutations as M, reads, settings
from sedimenta.streaming import journal_stream


def test_profiles_and_precedence():
    assert settings.journal_settings() == settings.Journal()
    business = settings.journal_settings("business", min_gain=1)
    assert (business.compress, business.min_gain, business.sync_every, business.extent_size) == (True, 1, 64, 8 << 20)
    assert not settings.journal_settings("business", compress_off=True, compress=True).compress
    assert settings.inherited({"chunk_size": 4096, "seed": 7, "file_count": 3}, seed=9) == settings.Codec(chunk_size=4096, seed=9)
    with pytest.raises(ValueError):
        settings.Codec(block_size=0)


def test_clamp_and_shapes(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-1.0,), (0.25,), (9.0,)], "x double")
    assert [r[0] for r in df.select(settings.clamped(F.col("x"))).collect()] == [0.5, 0.5, 0.0, 0.25, 1.0]
    one = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert [one.select(reads.shaped(F.col("v"), F.lit(n))).first()[0] for n in (0, 1, 3)] == [[], [1.0], [1.0, 2.0, 0.0]]


@pytest.fixture(scope="module")
def live(spark):
    rows = [("a", 3, 0), ("a/x", 1, 5), ("b/c/y", 1, 7), ("l", 2, 3), ("e", 3, 0), ("ab", 1, 1)]
    return spark.createDataFrame(rows, "path string, type int, size long")


def test_removals(spark, live):
    ops = [(p, o) for p in ("a", "a/x", "b", "b/c", "l", "e", "none") for o in ("unlink", "rmdir")]
    got = {(r.path, r.op): r.error for r in M.removal_errors(live, spark.createDataFrame(ops, "path string, op string")).collect()}
    assert got["a", "unlink"] == "EISDIR" and got["a", "rmdir"] == got["b", "rmdir"] == "ENOTEMPTY" and got["e", "rmdir"] is None
    assert got["a/x", "unlink"] is None and got["a/x", "rmdir"] == "ENOTDIR" and got["l", "unlink"] is None and got["none", "rmdir"] == "ENOENT"
    assert M.removal_errors(live.limit(0), spark.createDataFrame([("a", "unlink")], "path string, op string")).first().error == "ENOENT"


def test_rename_orders_records(live):
    rows = M.renamed(live, "a", "z/a", F.lit(9), 10).orderBy("seq").collect()
    assert [(r.seq, r.path, r.type) for r in rows] == [(11, "z/a", 3), (12, "z/a/x", 1), (13, "a/x", 4), (14, "a", 4)]
    with pytest.raises(ValueError):
        M.renamed(live, "a", "a/b", F.lit(9), 10)


def test_commit_of_small_and_large_files(spark):
    files = spark.createDataFrame([("s", 10), ("n", 0), ("l", 25)], "path string, size long")
    got = sorted((r.path, r.ordinal, r.type, r["size"], r.file_offset, r.raw_len) for r in M.committed(files, 10, 10).collect())
    assert got == [("l", 0, 5, 0, 0, 10), ("l", 1, 5, 0, 10, 10), ("l", 2, 5, 0, 20, 5), ("l", 3, 6, 25, 0, 0), ("n", 0, 1, 0, 0, 0), ("s", 0, 1, 10, 0, 10)]


def test_compaction_applied_again_changes_nothing(spark, tmp_path):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    j = spark.createDataFrame([(1, 4, 0, "a", 5, 0), (2, 1, 0, "c", 6, 9)], "seq long, type int, flags int, path string, mtime_ns long, size long")
    M.compact(base, j, str(tmp_path / "1"))
    new = spark.read.parquet(str(tmp_path / "1/base"))
    assert sorted((r.path, r["size"]) for r in new.collect()) == [("b", 2), ("c", 9)]
    assert spark.read.parquet(str(tmp_path / "1/journal")).count() == 0 and spark.read.parquet(str(tmp_path / "1/watermark")).first().watermark == 6
    again = J.overlay(new.select("path", "size"), j).select("path", "size")
    assert sorted(map(tuple, again.collect())) == [("b", 2), ("c", 9)]


def test_wrong_chunks(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, b"abc"), (3, b"")], "k int, data binary").withColumn("crc32", F.when(F.col("k") != 3, F.crc32("data")))
    hit = df.withColumn("data", F.when(F.col("k") == 2, checks.flipped(F.col("data"), F.lit(1))).otherwise(F.col("data")))
    assert [r.k for r in checks.wrong_chunks(hit).collect()] == [2] and hit.where("k = 2").first().data == b"a\x9dc"


def test_streams_of_several_batches(spark, tmp_path):
    schema = "seq long, type int, flags int, path string, mtime_ns long, size long"
    batches = [[(1, 1, 0, "a", 1, 1), (2, 5, 0, "x", 2, 0)], [(3, 1, 0, "b", 3, 2), (4, 4, 0, "a", 4, 0)], [(5, 6, 0, "x", 5, 8), (6, 5, 0, "x", 6, 0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.path: (r.seq, r.type) for r in journal_stream.latest_state(spark, stream()).collect()}
    assert got == {"a": (4, 4), "b": (3, 1), "x": (5, 6)}
    left = journal_stream.pending_extents(spark, stream(), lambda df: df.withColumn("raw_len", F.lit(3)))
    assert [tuple(r) for r in left.collect()] == [("x", 1, 3)]
    lines = stream().select(F.lit("info").alias("level"), F.col("path").alias("line"))
    chunks = journal_stream.log_chunks(spark, lines, 1)
    assert chunks.agg(F.sum("lines")).first()[0] == 6
