"""Result frames of codec and journal benchmarks: one row for each variant, made where the data are."""

from __future__ import annotations

import bz2
import gzip
import lzma
import time

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from ..operators.journal import keep_compressed

#: The variants of the codec: with and without stored ranks, over each transform.
VARIANTS = tuple((f"{'rank' if r else 'norank'}+{t}", r, t) for r in (True, False) for t in ("none", "delta", "xor", "evenodd"))
CHUNK_SIZES = tuple(1 << k for k in range(16, 21))


def _own(name: str, ranks: bool):
    def restore(coded, sizes):
        return codec.decode_chunks([c[0] for c in coded], [c[1] for c in coded], sizes, [0] * len(sizes), [0] * len(sizes), name)

    return (lambda chunks: codec.encode_chunks(chunks, [0] * len(chunks), [0] * len(chunks), name, ranks)), restore, (lambda c: len(c[1]))


def _each(pack, restore):
    """A compressor of single chunks over a list of them."""
    return (lambda chunks: [pack(d) for d in chunks]), (lambda coded, sizes: [restore(c, n) for c, n in zip(coded, sizes)]), len


#: name -> (compress chunks, decompress given the sizes, stored size of one)
TOOLS = {
    "gzip": _each(lambda d: gzip.compress(d, 6), lambda c, n: gzip.decompress(c)),
    "bzip2": _each(bz2.compress, lambda c, n: bz2.decompress(c)),
    "xz": _each(lzma.compress, lambda c, n: lzma.decompress(c)),
    "zstd": _each(lambda d: zstandard.ZstdCompressor(3).compress(d), lambda c, n: zstandard.ZstdDecompressor().decompress(c, n)),
    "lz4": _each(lambda d: pa.compress(d, "lz4", asbytes=True), lambda c, n: pa.decompress(c, n, "lz4", asbytes=True)),
}
OWN = {name: _own(t, r) for name, r, t in VARIANTS}


def compare(chunks: DataFrame, names: list[str]) -> DataFrame:
    """For each named tool or codec variant over chunks(data): chunks, ok (all come back equal), orig, comp, ratio (0 if
    empty), comp_s and decomp_s. Every batch of chunks goes through each tool, and is summed before the shuffle."""
    known = {**TOOLS, **OWN}

    def run(batches):
        for df in batches:
            raw = [bytes(d) for d in df["data"]]
            out = []
            for name in names:
                pack, restore, size = known[name]
                t0 = time.perf_counter()
                packed = pack(raw)
                t1 = time.perf_counter()
                back = restore(packed, [len(d) for d in raw])
                t2 = time.perf_counter()
                out.append((name, len(raw), back == raw, sum(map(len, raw)), sum(map(size, packed)), t1 - t0, t2 - t1))
            yield pd.DataFrame(out, columns=["name", "n", "same", "orig", "comp", "comp_s", "decomp_s"])

    rows = chunks.select("data").mapInPandas(run, "name string, n bigint, same boolean, orig bigint, comp bigint, comp_s double, decomp_s double")
    s = rows.groupBy("name").agg(F.sum("n").alias("chunks"), F.min("same").alias("ok"), F.sum("orig").alias("orig"), F.sum("comp").alias("comp"), F.sum("comp_s").alias("comp_s"), F.sum("decomp_s").alias("decomp_s"))
    return s.withColumn("ratio", F.round(F.coalesce(F.col("comp") / F.nullif(F.col("orig"), F.lit(0)), F.lit(0.0)), 6))


def journal_sweep(records: DataFrame, raw: Column, stored: Column, min_sizes: tuple, cadences: tuple, min_gains: tuple) -> DataFrame:
    """Every combination of least size, records a sync and least gain over the same records, from one pass: records,
    compressed_records, bytes_raw, bytes_stored, fsyncs, ratio."""
    variants = [F.struct(F.lit(s).alias("min_size"), F.lit(c).alias("sync_every"), F.lit(g).alias("min_gain")) for s in min_sizes for c in cadences for g in min_gains]
    each = records.select(raw.cast("bigint").alias("raw"), stored.cast("bigint").alias("stored"), F.explode(F.array(*variants)).alias("v")).select("raw", "stored", "v.*")
    kept = keep_compressed(F.col("raw"), F.col("stored"), F.col("min_size"), F.col("min_gain"))
    s = each.groupBy("min_size", "sync_every", "min_gain").agg(
        F.count("*").alias("records"),
        F.sum(kept.cast("bigint")).alias("compressed_records"),
        F.sum("raw").alias("bytes_raw"),
        F.sum(F.when(kept, F.col("stored")).otherwise(F.col("raw"))).alias("bytes_stored"),
    )
    fsyncs = F.ceil(F.col("records") / F.col("sync_every")).cast("bigint")
    return s.withColumn("fsyncs", fsyncs).withColumn("ratio", F.round(F.coalesce(F.col("bytes_stored") / F.nullif(F.col("bytes_raw"), F.lit(0)), F.lit(0.0)), 6))
