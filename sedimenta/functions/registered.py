"""Functions by name for Spark SQL: byte_entropy, codec_encode, codec_decode, path_normalize."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import codec


def register(spark: SparkSession) -> None:
    """byte_entropy(data), codec_encode(data, file_id, chunk), codec_decode(codec_id, payload, size, file_id, chunk) and
    path_normalize(path, base-relative). Null data count as empty."""

    @F.pandas_udf("double")
    def byte_entropy(data: pd.Series) -> pd.Series:
        return pd.Series([codec.entropy_of(bytes(x or b"")) for x in data])

    spark.udf.register("byte_entropy", byte_entropy)
    spark.udf.register("codec_encode", codec.encode_udf())
    spark.udf.register("codec_decode", codec.decode_udf())
    parts = "filter(split(p, '/'), x -> x NOT IN ('', '.'))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION path_normalize(p STRING) RETURNS STRING RETURN array_join({parts}, '/')")
