"""Stores of rows with a key, in a fixed number of folders.

A store is a parquet folder with ``buckets`` sub-folders; a row lies in the one that the hash of its ``within`` columns
names, so the number of folders never grows with users or sessions. A batch reads the folders that its own rows hash
to and no others: their numbers (at most ``buckets``) go into the scan as a partition filter.

Keys are compared by a digest of their columns in which a null is a value of its own, so null keys match. ``add`` drops
rows whose key is stored or stands earlier in the batch, so a retried or replayed batch adds nothing. Writes are
rebalanced by folder: a small batch makes about one file per folder, a folder with very many new rows gets several files
from several tasks. ``compact`` merges the small files that many batches leave.

One job at a time writes to a store; any number may read it (not while it is compacted).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import pinned, read_if_there

BUCKETS = 256
BUCKET, DIGEST = "bucket", "key_digest"
FILES_PER_BUCKET = 8     # more than these are merged by ``compact``


def key_digest(df: DataFrame, columns) -> Column:
    """md5 of the columns' values; each is written with its length, and a null as a mark of its own."""
    def part(name):
        kind = df.schema[name].dataType.typeName()
        value = F.unix_micros(F.col(name).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz") else F.col(name)
        text = value.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("null"))
    return F.md5(F.concat_ws(",", *[part(c) for c in columns]))


@dataclass(frozen=True)
class KeyedStore:
    """``keys`` identify a row; ``within`` (all of them by default) say in which folder it lies."""

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    within: tuple[str, ...] = ()
    buckets: int = BUCKETS

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).fieldNames()

    def _bucket(self, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(key_digest(df, self.within or self.keys)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame | None:
        if read_if_there(self.spark, self.path) is None:
            return None
        return self.spark.read.schema(f"{self.schema}, {DIGEST} string, {BUCKET} int").parquet(self.path)

    def _touched(self, rows: DataFrame) -> DataFrame | None:
        """The stored rows in the folders of ``rows``; these hold the ``within`` columns."""
        stored = self._stored()
        if stored is None:
            return None
        numbers = [r[0] for r in rows.select(self._bucket(rows)).distinct().collect()]   # at most ``buckets`` numbers
        return stored.where(F.col(BUCKET).isin(numbers)) if numbers else stored.where(F.lit(False))

    def new_rows(self, rows: DataFrame, order: str | None = None, unique: bool = False) -> DataFrame:
        """What ``add`` would write: one row for each key of the batch that is not stored, the least by ``order`` (or by all
        values); rows whose keys are ``unique`` are not compared. The batch is read twice: give it written."""
        columns = self.columns
        keyed = rows.select(*columns, *([order] if order and order not in columns else []), key_digest(rows, self.keys).alias(DIGEST),
                            self._bucket(rows).alias(BUCKET))
        held = F.struct(*columns)
        # partial in every task, so a key that very many rows share sends one row from each
        first = keyed.groupBy(BUCKET, DIGEST).agg((F.min_by(held, F.struct(order, *columns)) if order else F.min(held)).alias("row"))
        new = keyed if unique else first.select("row.*", DIGEST, BUCKET)
        stored = self._touched(rows)
        if stored is not None:
            new = new.join(stored.select(BUCKET, DIGEST), [BUCKET, DIGEST], "left_anti")
        return new.select(*columns, DIGEST, BUCKET)

    def add(self, rows: DataFrame, order: str | None = None, unique: bool = False) -> None:
        """Appends the new rows."""
        new = self.new_rows(pinned(rows, "batch") if self._stored() is not None else rows, order, unique)
        new.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def read(self, rows: DataFrame | None = None) -> DataFrame:
        """All rows, or those in the folders that ``rows`` hash to (a superset of the rows that share their ``within`` columns)."""
        found = self._stored() if rows is None else self._touched(rows)
        return self.spark.createDataFrame([], self.schema) if found is None else found.select(*self.columns)

    def matching(self, rows: DataFrame) -> DataFrame:
        """The stored rows that share all ``within`` columns with one of ``rows``, null with null."""
        wanted = list(self.within or self.keys)
        found = self.read(rows)
        found = found.withColumn("_wanted", key_digest(found, wanted))
        asked = rows.select(key_digest(rows, wanted).alias("_wanted")).distinct()
        return found.join(asked, "_wanted", "left_semi").drop("_wanted")

    def compact(self, files: int = FILES_PER_BUCKET, keep=None) -> int:
        """Merges the folders that hold more than ``files`` files; returns how many did. The rows are first written anew
        elsewhere, then put in place of the folders' files; with ``keep(rows)`` only what it returns of a folder's rows."""
        stored = self._stored()
        if stored is None:
            return 0
        crowded = [r[0] for r in stored.select(BUCKET, F.input_file_name().alias("file")).distinct().groupBy(BUCKET).count()
                   .where(F.col("count") > files).collect()]                              # at most ``buckets`` numbers
        if crowded:
            rows = stored.where(F.col(BUCKET).isin(crowded))
            copy = pinned(rows if keep is None else keep(rows), "compacted")
            copy.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                .partitionBy(BUCKET).parquet(self.path)
        return len(crowded)
