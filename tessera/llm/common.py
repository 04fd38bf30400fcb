"""Tables, shared stores and column helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import read_table, scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; also makes the package importable by the Python workers."""
    ship_package(spark)
    return read_table(spark, sf_dir, name)


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the session's shared folder and read it back (cuts lineage, survives lost executors)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mod_crc32(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
