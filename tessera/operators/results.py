"""Keyed result store: memorize (insert if absent) and recall by (user, session, name)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.keyed import KeyedStore

RESULT_KEY = ["user_id", "session_id", "stored_result_name"]


def result_rows(df: DataFrame, order_col: str) -> DataFrame:
    """Per key the first row of the batch (by ``order_col``), with its store id.

    ``min_by`` is aggregated partially on the map side, so a hot key is reduced
    inside each task before it is shuffled.
    """
    first = df.groupBy(*RESULT_KEY).agg(F.min_by(F.col("text"), F.col(order_col)).alias("text"))
    return first.withColumn("id", F.concat_ws("_", *RESULT_KEY))


def _key_join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by equal keys, null with null; the left table's keys stay."""
    named = {c: f"_right_{c}" for c in RESULT_KEY}
    right = right.select(*[F.col(c).alias(named.get(c, c)) for c in right.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(named[c])) for c in RESULT_KEY])
    return left.join(right, same, how).drop(*named.values())


def memorize_results(df: DataFrame, store: DataFrame | None, order_col: str = "ts") -> DataFrame:
    """Rows to add to the store; a key already stored keeps its row.

    The caller appends the result (``write.mode('append')``); the input passes
    through unchanged for the next step of a chain. ``memorize_into`` does both
    on a stored table, of which only the folders of the batch's keys are read.
    """
    new = result_rows(df, order_col)
    if store is not None:
        new = _key_join(new, store.select(*RESULT_KEY), "left_anti")
    return new.select("id", *RESULT_KEY, "text")


STORE_SCHEMA = "id string, user_id string, session_id string, stored_result_name string, text string"


def result_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, STORE_SCHEMA, tuple(RESULT_KEY))


def memorize_into(df: DataFrame, path: str, order_col: str = "ts") -> None:
    """E1 on a stored table: the first row of each key that is not stored yet is appended."""
    rows = result_rows(df, order_col).select("id", *RESULT_KEY, "text")
    result_store(df.sparkSession, path).add(rows)


def recall_from(keys: DataFrame, path: str) -> DataFrame:
    """E2 on a stored table: only the folders of the requested keys are read."""
    return recall_results(keys, result_store(keys.sparkSession, path).read(keys))


def store_after(df: DataFrame, store: DataFrame | None, order_col: str = "ts") -> DataFrame:
    """The store as it is after ``memorize_results`` was appended."""
    added = memorize_results(df, store, order_col)
    return added if store is None else store.select("id", *RESULT_KEY, "text").unionByName(added)


def wanted_rows(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the store whose key is among ``keys`` (a small table is sent to the store's tasks)."""
    return _key_join(store, keys.select(*RESULT_KEY), "left_semi")


def recall_results(keys: DataFrame, store: DataFrame) -> DataFrame:
    """The stored text for each requested key (null with null), null when none."""
    return _key_join(keys.select(*RESULT_KEY), store.select(*RESULT_KEY, "text"), "left")
