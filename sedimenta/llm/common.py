"""Shared pieces of the llm operators: input shaping, Arrow batches, checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but space and the ASCII controls 9 to 13.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two needed columns; a null text counts as empty, other columns of any name are dropped."""
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))


def all_columns(docs: DataFrame) -> list[Column]:
    """Every column of docs by its quoted name, so that names with dots or backticks stay whole."""
    return [F.col(quoted(c)) for c in docs.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def byte_column(column: pa.Array) -> list:
    """A string column as a list of bytes; cheaper than decoding when words are split at ASCII."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def in_slices(batch: pa.RecordBatch, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose columns hold about max_bytes each, one row at least."""
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, max_bytes // per_row)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one set already. A folder of this machine only
    where neither is there and the master is local, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if known.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Files that checkpoint_few writes at most for each core of the cluster.
FILES_A_CORE = 8


def checkpoint_few(df: DataFrame) -> DataFrame:
    """As checkpoint, by FILES_A_CORE tasks a core at most, each taking some partitions one after another.

    Without Hadoop's native library a local file system starts a process (chmod) for each file and each of its checksums.
    Until that process runs its program, it is counted with all the memory of the executor that started it."""
    return checkpoint(df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism))
