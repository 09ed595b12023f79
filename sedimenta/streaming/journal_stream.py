"""The journal as a stream: latest state by path, incremental compaction by watermark, chunked log sink."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.journal import EXTENT
from ..operators.shared import shared_folder


def stream_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or file as a stream of files."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may match a file as well as a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(pattern)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str, folder: str) -> None:
    """Run all that is there through foreachBatch; offsets and state live in the shared folder."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def updates(spark: SparkSession, state: DataFrame, key: list[str], folder: str) -> DataFrame:
    """What a stream of changed rows leaves: each batch writes only the keys that it changed, to a folder of its own (a
    batch that is run again writes the same one), and the last batch of a key holds its row."""
    drain(state, lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/changed/batch={n}"), "update", folder)
    rows = spark.read.parquet(f"{folder}/changed")
    others = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("row")).select(*key, "row.*")


def latest_state(spark: SparkSession, journal: DataFrame) -> DataFrame:
    """The winning record of each path, kept as aggregation state across batches; only changed paths are written."""
    version = F.max(F.struct("mtime_ns", "seq", "type", "size")).alias("v")
    state = journal.where(F.col("type") != EXTENT).groupBy("path").agg(version).select("path", "v.*")
    return updates(spark, state, ["path"], stream_folder(spark))


def pending_extents(spark: SparkSession, rows: DataFrame, to_journal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, pending, bytes) of extents that no later record of their path settles. Each batch of the stream is made
    journal records and appended; what is pending follows from the last settling record of each path."""
    folder = stream_folder(spark)
    drain(rows, lambda batch, n: to_journal(batch).write.mode("overwrite").parquet(f"{folder}/records/batch={n}"), "append", folder)
    records = spark.read.parquet(f"{folder}/records")
    version = F.struct("mtime_ns", "seq")
    settled = records.groupBy("path").agg(F.max(F.when(F.col("type") != EXTENT, version)).alias("v"))
    left = records.where(F.col("type") == EXTENT).join(settled, "path").where(F.col("v").isNull() | (version > F.col("v")))
    return left.groupBy("path").agg(F.count("*").alias("pending"), F.sum("raw_len").alias("bytes"))


def log_chunks(spark: SparkSession, lines: DataFrame, threshold: int) -> DataFrame:
    """(level, lines, bytes, data) of chunks: each batch's lines of a level, buffered until `threshold` bytes are held or
    the batch ends, then compressed."""
    folder = stream_folder(spark)
    schema = pa.schema([("level", pa.string()), ("lines", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])

    def flush(batches):
        now, held, size = None, [], 0

        def chunk():
            return pa.RecordBatch.from_pylist([{"level": now, "lines": len(held), "bytes": size, "data": zlib.compress("\n".join(held).encode())}], schema)

        for batch in batches:
            for level, line in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (level != now or size >= threshold):
                    yield chunk()
                    held, size = [], 0
                now, size = level, size + len((line or "").encode())
                held.append(line or "")
        if held:
            yield chunk()

    def write(batch: DataFrame, n: int) -> None:
        # a level is spread over parts, so a hot one is no single task's
        parts = batch.withColumn("part", F.pmod(F.xxhash64("line"), F.lit(16))).repartition("level", "part").sortWithinPartitions("level")
        parts.select("level", "line").mapInArrow(flush, "level string, lines bigint, bytes bigint, data binary").write.mode("overwrite").parquet(f"{folder}/chunks/batch={n}")

    drain(lines, write, "append", folder)
    return spark.read.parquet(f"{folder}/chunks").drop("batch")


def compaction(spark: SparkSession, journal: DataFrame, watermark: int) -> DataFrame:
    """Records from the watermark on, appended batch by batch; a batch that is run again writes the same folder."""
    folder = stream_folder(spark)
    drain(journal.where(F.col("mtime_ns") >= watermark), lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/applied/batch={n}"), "append", folder)
    return spark.read.parquet(f"{folder}/applied").drop("batch")


def windowed_levels(spark: SparkSession, events: DataFrame, width: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """Counts by event-time window and type. Rows later than the bound behind the newest are left out, and windows that
    it has passed are dropped from the state; each batch writes the windows it changed."""
    counted = events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    rows = counted.select(F.col("window.start").alias("start"), "event_type", "n")
    return updates(spark, rows, ["start", "event_type"], stream_folder(spark))
