"""Fixity audit of WARC archives by Merkle trees.

A record is one WARC record with its offset in the archive. Records are hashed where they are read; only (offset, length,
digest) moves on. A tree's lowest nodes cover fixed ranges of ``RANGE_BYTES`` offsets, each further level ``FANOUT`` nodes of the
one below, up to one root; a node's digest is SHA-256 over its children's places and digests in order, so every group that is
brought together is bounded by the range or the fan-out. Levels are written as tables.

Two replicas are compared from the root: only nodes whose digests differ have their children looked up, and below the lowest
nodes only the records of differing ranges are compared. Sound branches are never read.

Offsets come from ``archive_layout``: running sums over ranges of the order column, so no single task sees all records. A null
url or body counts as empty, a null page id sorts first; repeated rows are records of their own at their own offsets.
Records that claim one offset twice are hashed as one slot. Empty archives have no root and no differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pin, table

RANGE_BYTES = 1 << 16
FANOUT = 16
#: fixed by the WARC format (version line and the header fields used here)
_HEADER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%s>\r\nWARC-Target-URI: %s\r\nContent-Length: %s\r\n\r\n"


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """The record's text: header, body and the two line ends after it."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.format_string(_HEADER, F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("")),
                                    F.octet_length(body).cast("string")), body, F.lit("\r\n\r\n"))


def archive_layout(records: DataFrame, order: str, length: str = "length") -> DataFrame:
    """``records`` with ``offset``: the sum of the lengths before, by ``order`` (ties as they are read)."""
    sorted_ = records.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(order, "_read") \
        .withColumn("_part", F.spark_partition_id())
    parts = pin(sorted_, "layout")                       # the division into parts must not change between its two uses
    sums = parts.groupBy("_part").agg(F.sum(length).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # one row for each part
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_first(), "_read").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(starts, "_part") \
        .withColumn("offset", (F.col("_start") + F.col("_before")).cast("bigint")).drop("_read", "_part", "_start", "_before")


def _node_digest(place: str, digest: str) -> Column:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, digest))),
                                      lambda c: F.concat_ws(":", c[place].cast("string"), c[digest])), ",")
    return F.sha2(joined, 256)


class MerkleTree:
    """The levels of one replica's tree; level 0 holds the slots, the last one the root."""

    def __init__(self, records: DataFrame, height: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT):
        slots = records.groupBy("offset").agg(F.count("*").alias("n"), F.min("length").alias("length"), F.min("digest").alias("low"),
                                              F.max("digest").alias("high"), F.sum(F.xxhash64("length", "digest").cast("decimal(38,0)")).alias("sum"))
        slots = slots.select((F.col("offset")).alias("node"), F.floor(F.col("offset") / range_bytes).cast("bigint").alias("parent"), "length",
                             F.when(F.col("n") == 1, F.concat_ws("+", "length", "low"))
                             .otherwise(F.concat_ws("+", "length", "low", "high", "n", "sum")).alias("digest"))
        self.levels = [pin(slots, "slots")]
        for _ in range(height):
            below = self.levels[-1]
            level = below.groupBy(F.col("parent").alias("node")).agg(_node_digest("node", "digest").alias("digest"))
            self.levels.append(pin(level.select("node", F.floor(F.col("node") / fanout).cast("bigint").alias("parent"), "digest"), "level"))

    def root(self) -> str | None:
        top = self.levels[-1].select("digest").head(1)
        return top[0][0] if top else None


def tree_height(size: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the slots until one node covers ``size`` bytes of offsets."""
    nodes, height = max(1, -(-size // range_bytes)), 1
    while nodes > 1:
        nodes, height = -(-nodes // fanout), height + 1
    return height


def fixity_audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Slots that differ between two replicas, tables of (offset, length, digest):

    offset, left_length, left_digest, right_length, right_digest, finding ('missing', 'added' or 'altered').
    """
    size = left.select("offset").unionAll(right.select("offset")).agg(F.max("offset")).head()[0]
    height = tree_height((size or 0) + 1, range_bytes, fanout)
    a, b = MerkleTree(left, height, range_bytes, fanout), MerkleTree(right, height, range_bytes, fanout)
    suspects = None
    for level in range(height, -1, -1):
        x, y = a.levels[level], b.levels[level]
        if suspects is not None:                       # only children of nodes that differ
            x, y = x.join(suspects, "parent", "left_semi"), y.join(suspects, "parent", "left_semi")
        keep = [c for c in x.columns if c not in ("node", "parent")]
        both = x.select("node", *[F.col(c).alias(f"left_{c}") for c in keep]).join(
            y.select("node", *[F.col(c).alias(f"right_{c}") for c in keep]), "node", "full_outer")
        differing = both.where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))
        if level:
            suspects = pin(differing.select(F.col("node").alias("parent")), "suspects")
    return differing.select(F.col("node").alias("offset"), "left_length", F.substring_index("left_digest", "+", -1).alias("left_digest"),
                            "right_length", F.substring_index("right_digest", "+", -1).alias("right_digest"),
                            F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "added")
                            .otherwise("altered").alias("finding"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Audits the archive of all pages against a replica with damage derived from it: of every 97 page ids, one has a byte
    turned and one is lost."""
    pages = table(spark, sf_dir, "pages")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    damaged = F.when(F.pmod("page_id", F.lit(97)) == 5, F.overlay(record, F.lit("~"), F.lit(40))) \
        .when(F.pmod("page_id", F.lit(97)) == 11, F.lit(None)).otherwise(record)
    hashed = pages.select("page_id", F.octet_length(record).cast("bigint").alias("length"), F.sha2(record, 256).alias("digest"),
                          F.sha2(damaged, 256).alias("damaged"))
    laid = pin(archive_layout(hashed, "page_id"), "archive")
    found = fixity_audit(laid.select("offset", "length", "digest"),
                         laid.where("damaged is not null").select("offset", "length", F.col("damaged").alias("digest")))
    found = found.fillna({"right_length": -1, "right_digest": ""})
    return found.join(laid.select("offset", "page_id"), "offset")


OP1_SQL = """
WITH p AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
o AS (SELECT *, cast(coalesce(sum(strlen(record)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
SELECT start AS offset, cast(strlen(record) AS BIGINT) AS left_length, sha256(record) AS left_digest,
  CASE WHEN page_id % 97 = 5 THEN cast(strlen(record) AS BIGINT) ELSE -1 END AS right_length,
  CASE WHEN page_id % 97 = 5 THEN sha256(substr(record, 1, 39) || '~' || substr(record, 41)) ELSE '' END AS right_digest,
  CASE WHEN page_id % 97 = 5 THEN 'altered' ELSE 'missing' END AS finding, page_id
FROM o WHERE page_id % 97 IN (5, 11)
"""
