"""Document library: hash, split, pack, ingest, embed and exact filtered top-k search.

Every operator is a DataFrame -> DataFrame function. Text work is native
(regex, ``split``, an ``aggregate`` fold for packing); the hashing encoder counts
buckets per row. Vector distances run in numpy where a region of the index meets
its queries (``mapInArrow`` over sorted rows): Spark 4.1 has no vector functions, and higher-order
lambdas over arrays run interpreted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_hash, sentences
from tessera.session import pinned, scratch_path, ship_package

# Fixed values that must equal the reference's for right results.
MAX_CHUNK_CHARS = 1024
SEARCH_K = 5
SOURCE_OPEN = "\n [Source: "
SOURCE_CLOSE = "]\n"
ADDED_MSG = ("Document", "added to collection and embedded")
EXISTING_MSG = ("Document ", " is already existing in the collection and loaded")

DEFAULT_DIM = 384
HASH_PREFIX_CHARS = 2  # library partitions: first two hex digits of the content hash (256)


# D2 ------------------------------------------------------------------------
def pack_chunks(sents, max_chars: int = MAX_CHUNK_CHARS):
    """Greedy packing of sentences into chunks of at most ``max_chars``.

    If the current chunk plus the next sentence is longer than the limit, the
    chunk is emitted and a new one starts; every sentence is followed by one
    space. A sentence longer than the limit stays whole, and a too-long first
    sentence emits an empty first chunk. Empty input gives no chunks.
    """
    sents = F.col(sents) if isinstance(sents, str) else sents

    def packed(texts):
        # the fold sees lengths only and keeps the numbers of the sentences that begin a chunk; texts are sliced once
        init = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("seen"), F.array().cast("array<int>").alias("cuts"))

        def step(acc, size):
            full = acc["chars"] + size > max_chars
            return F.struct((F.when(full, 0).otherwise(acc["chars"]) + size + 1).alias("chars"), (acc["seen"] + 1).alias("seen"),
                            F.when(full, F.array_append(acc["cuts"], acc["seen"])).otherwise(acc["cuts"]).alias("cuts"))

        cuts = F.aggregate(F.transform(texts, F.length), init, step, lambda acc: acc["cuts"])

        def joined(cuts):
            begins = F.concat(F.array(F.lit(0)), cuts)
            ends = F.concat(cuts, F.array(F.size(texts)))
            return F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda c: F.when(
                c["a"] == c["b"], F.lit("")).otherwise(F.concat(F.array_join(F.slice(texts, c["a"] + 1, c["b"] - c["a"]), " "), F.lit(" "))))

        return F.when(F.size(texts) > 0, F.transform(F.array(cuts), joined)[0]).otherwise(F.when(texts.isNotNull(), F.array().cast("array<string>")))

    # a lambda's argument is computed once, however often it is used
    return F.transform(F.array(sents), packed)[0]


# D3 ------------------------------------------------------------------------
def chunk_documents(docs: DataFrame, text_col: str = "text", title_col: str = "title",
                    max_chars: int = MAX_CHUNK_CHARS, keep=()) -> DataFrame:
    """D3: one row per chunk: ``{hash}_chunk{i}`` (1-based), source title and hash.

    Narrow transformation only (no shuffle): each document is split and packed
    in place, then exploded.
    """
    packed = docs.select(
        *keep,
        content_hash(text_col).alias("content_hash"),
        F.col(title_col).alias("source"),
        pack_chunks(sentences(text_col), max_chars).alias("chunks"),
    )
    # the outer form and a test of its rows: for the plain one Spark infers a filter on the array, which packs every text twice
    return packed.select(
        *keep,
        "content_hash",
        "source",
        F.posexplode_outer("chunks").alias("pos", "text"),
    ).filter(F.col("pos").isNotNull()).select(
        *keep,
        F.concat(F.col("content_hash"), F.lit("_chunk"), (F.col("pos") + 1).cast("string")).alias("chunk_id"),
        (F.col("pos") + 1).alias("chunk_no"),
        "text",
        "source",
        "content_hash",
    )


def with_title(docs: DataFrame) -> DataFrame:
    """Adapter: a document's title is ``source/doc_id.txt``."""
    return docs.withColumn("title", F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))


# D4 / D5 -------------------------------------------------------------------
def _first_per_hash(docs: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """Keep the first document (by ``order_col``; one without it comes last) of each content hash.

    Texts are sent to other tasks once, and of a hash only the first document
    of each task: Spark applies the row-number limit before the shuffle.
    """
    first = Window.partitionBy("content_hash").orderBy(F.col(order_col).asc_nulls_last())
    hashed = docs.withColumn("content_hash", content_hash(text_col)).withColumn("_place", F.row_number().over(first))
    # of rows with equal hash and order one is kept
    return hashed.filter(F.col("_place") == 1).select("content_hash", *docs.columns)


def ingest_documents(new_docs: DataFrame, library_hashes: DataFrame | None, text_col: str = "text",
                     order_col: str = "doc_id") -> DataFrame:
    """The documents that are new to the library, one per content hash."""
    first = _first_per_hash(new_docs, text_col, order_col)
    if library_hashes is None:
        return first
    return first.join(_held(library_hashes, first), "content_hash", "left_anti")


def _held(library_hashes: DataFrame, batch: DataFrame) -> DataFrame:
    """Library hashes that occur in the batch.

    The library is filtered by the batch first (left-semi: the small batch is
    the build side AQE can broadcast at run time, and with a ``hash_prefix``
    partition column the scan is pruned), so a large library is not shuffled
    for every ingest.
    """
    keys = ["content_hash"]
    lib = library_hashes
    if "hash_prefix" in library_hashes.columns:
        keys = ["hash_prefix", "content_hash"]
        batch = batch.withColumn("hash_prefix", F.substring("content_hash", 1, HASH_PREFIX_CHARS))
    else:
        lib = lib.select("content_hash")
    return lib.join(batch.select(*keys).distinct(), keys, "left_semi").select("content_hash").distinct()


def ingest_status(new_docs: DataFrame, library_hashes: DataFrame | None, text_col: str = "text",
                  order_col: str = "doc_id", title_col: str = "title") -> DataFrame:
    """Per document, ``added`` or ``existing`` and the fixed message.

    A document is added when it is the first of its hash in the batch (one
    without an order comes last, of equal ones one is) and the hash is not yet
    in the library. Documents without a text are one document, which is added.
    """
    # written: the number tells documents of one hash and order apart, and is used twice
    hashed = pinned(new_docs.select(F.col(order_col).alias("_order"), F.col(title_col).alias("_title"), content_hash(text_col).alias("content_hash"),
                                    F.monotonically_increasing_id().alias("_row")), "status")
    place = F.struct(F.col("_order").isNull().alias("late"), "_order", "_row")
    firsts = hashed.groupBy("content_hash").agg(F.min(place)["_row"].alias("_first"))
    if library_hashes is not None:
        known = _held(library_hashes, firsts).withColumn("_known", F.lit(True))
        firsts = firsts.join(known, "content_hash", "left")
    else:
        firsts = firsts.withColumn("_known", F.lit(None).cast("boolean"))
    firsts = firsts.withColumnRenamed("content_hash", "_hash")
    joined = hashed.join(firsts, F.col("content_hash").eqNullSafe(F.col("_hash")))
    added = (F.col("_row") == F.col("_first")) & F.col("_known").isNull()
    text = lambda msg: F.concat(F.lit(msg[0]), F.coalesce("_title", F.lit("")), F.lit(msg[1]))
    return joined.select(
        F.col("_order").alias(order_col),
        "content_hash",
        F.when(added, F.lit("added")).otherwise(F.lit("existing")).alias("status"),
        F.when(added, text(ADDED_MSG)).otherwise(text(EXISTING_MSG)).alias("message"),
    )


# D6 ------------------------------------------------------------------------
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def hash_tokens(text_col) -> "F.Column":
    """Lower-cased word tokens of a text, empty pieces removed."""
    col = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.array_remove(F.split(F.lower(col), TOKEN_SPLIT), "")


def token_bucket(tok, dim: int = DEFAULT_DIM):
    """Bucket of a token: first 8 hex digits of its md5, modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(tok.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim))


def embed(df: DataFrame, key: str, text_col: str, dim: int = DEFAULT_DIM, encoder=None,
          encoder_factory=None, keep=()) -> DataFrame:
    """``(key, *keep, embedding array<float>)`` for every input row.

    With ``encoder`` (a function ``pandas.Series[str] -> list of vectors``) or
    ``encoder_factory`` (builds one; called once per Python worker) the texts go
    through an Arrow ``pandas_udf``. Without one the native hashing encoder is
    used: token counts per bucket, L2-normalised, counted inside the row, so
    nothing is shuffled and ``key`` may repeat. A text without tokens has a
    zero vector.
    """
    if encoder is not None or encoder_factory is not None:
        return _embed_with_encoder(df, key, text_col, encoder, encoder_factory, keep)
    ship_package(df.sparkSession)
    tokens = F.coalesce(hash_tokens(text_col), F.array().cast("array<string>"))
    return df.select(key, *keep, _bucket_vectors(dim)(tokens).alias("embedding"))


def _bucket_vectors(dim: int):
    """Counts of a row's tokens by bucket as a unit vector: a distinct token of an Arrow batch is hashed once, as ``token_bucket`` does."""
    from hashlib import md5

    import numpy as np
    import pyarrow.compute as pc

    @F.arrow_udf("array<float>")
    def vectors(rows: pa.Array) -> pa.Array:
        out = []
        sizes, tokens = rows.value_lengths().to_numpy(), rows.flatten().dictionary_encode()
        # tokens are letters and digits only: one text of the distinct ones is split at once
        distinct = pa.ListArray.from_arrays(pa.array([0, len(tokens.dictionary)], pa.int32()), tokens.dictionary.cast(pa.binary()))
        hashes = b"".join(md5(t).digest()[:4] for t in pc.binary_join(distinct, b" ")[0].as_py().split(b" "))
        buckets = (np.frombuffer(hashes, ">u4") % dim).astype(np.int32)[tokens.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for first in range(0, len(rows), 1000):
            part = sizes[first:first + 1000]
            owner = np.repeat(np.arange(len(part)), part)
            of = buckets[ends[first]:ends[first + len(part)]]
            counts = np.bincount(owner * dim + of, minlength=len(part) * dim).reshape(len(part), dim)
            norm = np.sqrt((counts * counts).sum(1))
            unit = (counts / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
            out.append(pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dim, dtype=np.int32), unit.ravel()))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.float32()))

    return vectors


def _embed_with_encoder(df: DataFrame, key: str, text_col: str, encoder, encoder_factory=None, keep=()) -> DataFrame:
    """A plugged model: ``encoder(texts)``, or ``encoder_factory()`` building the
    encoder once per Python worker (for models that are costly to load)."""
    from tessera.operators.complete import cached_model

    ship_package(df.sparkSession)

    @F.pandas_udf("array<float>")
    def _encode(texts: pd.Series) -> pd.Series:
        enc = encoder if encoder is not None else cached_model(encoder_factory)
        return pd.Series(list(enc(texts.fillna(""))))

    # nondeterministic: Catalyst must not run the model twice for one row
    return df.select(key, *keep, _encode.asNondeterministic()(F.col(text_col)).alias("embedding"))


# D7 ------------------------------------------------------------------------
def _seq_sqdist(A, B):
    """Exact squared distances of row pairs ``A[i], B[i]``, summed over dims in order (float64)."""
    import numpy as np

    acc = np.zeros(A.shape[0])
    for d in range(A.shape[1]):
        diff = A[:, d] - B[:, d]
        acc += diff * diff
    return acc


def _approx_sqdist(A, B):
    """|A| x |B| squared distances by one matrix product (float error, see ``_slack``)."""
    import numpy as np

    return np.maximum((A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2.0 * (A @ B.T), 0.0)


def _slack(A, B):
    """Bound on |approx - exact| per row of A, plus the 6-digit rounding step."""
    scale = (A * A).sum(1) + ((B * B).sum(1).max() if len(B) else 0.0)
    return 2e-6 + 1e-9 * scale


@dataclass
class VectorIndex:
    """A built search index: the chunk vectors in blocks (a table, sorted by cell and ring), where each block's cells and rings
    lie (a narrow table), and per-cell statistics and centroids (bounded: at most ``max_cells`` entries)."""

    data: DataFrame            # cid, v, cell, r (distance to the cell's centroid), norm, block
    rings: DataFrame           # block, cell, r_min, r_max
    centroids: "object"        # numpy array, cells x dim
    cells: "object"
    counts: "object"
    radii: "object"
    norm: float                # largest squared length of a vector
    ctype: str


BLOCK_ROWS = 1024        # vectors of a block, and of any slice that Python works on


def _slices(batch):
    return (batch.slice(k, BLOCK_ROWS) for k in range(0, batch.num_rows, BLOCK_ROWS))


def _matrix(lists):
    """The equally long lists of an Arrow column as the rows of a matrix."""
    if lists.null_count or len(lists.value_lengths().unique()) > 1:
        raise ValueError("vectors are null or differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _selected(chunks: DataFrame, ids: "DataFrame | list | None", ckey: str, cvec: str, chash: str) -> DataFrame:
    """``cid, v`` of the chunks restricted to ``ids``."""
    cand = chunks
    if isinstance(ids, (list, tuple, set)):
        cand = cand.filter(F.col(chash).isin(list(ids))) if ids else cand.limit(0)   # empty selection: nothing
    elif ids is not None:
        cand = cand.join(ids.select(F.col(ids.columns[0]).alias(chash)).distinct(), chash, "left_semi")
    return cand.select(F.col(ckey).alias("cid"), F.col(cvec).cast("array<float>").alias("v"))


def _cells(cand: DataFrame, max_cells: int) -> int:
    """Cells of an index."""
    return int(min(max_cells, max(8, round(math.sqrt(cand.count())))))


def _numbered(queries: DataFrame, qkey: str, qvec: str) -> DataFrame:
    """``qid, q, n`` of the queries. Single precision stays so; numbered and written: they are read several times."""
    kind = "array<float>" if dict(queries.dtypes)[qvec] == "array<float>" else "array<double>"
    return pinned(queries.select(F.col(qkey).alias("qid"), F.col(qvec).cast(kind).alias("q"), F.monotonically_increasing_id().alias("n")), "queries")


def _no_hits(spark, qtype: str, ctype: str, qkey: str, ckey: str) -> DataFrame:
    return spark.createDataFrame([], f"{qkey} {qtype}, rank int, {ckey} {ctype}, dist double")


def _ranked(found: DataFrame, qs: DataFrame, k: int, qkey: str, ckey: str) -> DataFrame:
    """The k first of the ``found`` rows of each numbered query, by distance and id."""
    w = Window.partitionBy("n").orderBy(F.col("dist"), F.col("cid"))
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.join(qs.select("n", "qid"), "n").select(F.col("qid").alias(qkey), "rank", F.col("cid").alias(ckey), "dist")


def build_index(chunks: DataFrame, ids: "DataFrame | list | None" = None, ckey: str = "cid", cvec: str = "embedding",
                chash: str = "content_hash", n_cells: int | None = None, max_cells: int = 1024,
                path: str | None = None) -> VectorIndex:
    """Place every chunk (restricted to ``ids``) in the cell of its nearest centroid and write the result once.

    Centroids are a deterministic spread of the chunks themselves (lowest
    ``xxhash64`` of the id), about sqrt(n) of them and at most ``max_cells``,
    so what ships to the tasks is bounded by ``max_cells x dim``. The placed
    table is written under the shared checkpoint folder (or ``path``) and read
    back: placement runs once, the statistics come from two narrow columns,
    and many query batches can search the same index.
    """
    import numpy as np
    import pyarrow as pa

    spark = chunks.sparkSession
    ship_package(spark)
    cand = _selected(chunks, ids, ckey, cvec, chash)
    ctype = dict(cand.dtypes)["cid"]
    if n_cells is None:
        n_cells = _cells(cand, max_cells)
    cents = [r[0] for r in cand.orderBy(F.xxhash64("cid"), "cid").select("v").limit(n_cells).collect()]
    C = np.asarray(cents, dtype=np.float64)

    # cell radii use the approximate distances, widened by the error bound
    def place(batches):
        for batch in batches:
            for part in _slices(batch):
                V = _matrix(part.column(1)).astype(np.float64)
                D = np.sqrt(_approx_sqdist(V, C))
                cell = D.argmin(axis=1)
                r = D[np.arange(len(V)), cell] + np.sqrt(_slack(V, C))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(r), pa.array((V * V).sum(1))],
                                                 names=["cid", "v", "cell", "r", "norm"])

    def number(batches):
        # blocks of rows that lie together: a cell's rows by their distance, then the next cell's
        first, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            block = first + (filled + np.arange(batch.num_rows)) // BLOCK_ROWS
            filled += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], names=[*batch.schema.names, "block"])

    path = path or scratch_path(spark, "vector-index")
    kind = f"cid {ctype}, v array<float>, cell int, r double, norm double"
    if len(cents):
        placed = cand.mapInArrow(place, kind)
        placed.repartitionByRange("cell", "r", "cid").sortWithinPartitions("cell", "r", "cid").mapInArrow(number, f"{kind}, block bigint").write.parquet(path)
        placed = spark.read.parquet(path)
    else:
        placed = spark.createDataFrame([], f"{kind}, block bigint")
    rings = pinned(placed.groupBy("block", "cell").agg(
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.count("*").alias("n"),
        F.max("norm").alias("norm")), "rings")
    stats = {r["cell"]: r for r in rings.groupBy("cell").agg(F.sum("n").alias("n"), F.max("r_max").alias("r"), F.max("norm").alias("norm")).collect()}
    cells = np.array(sorted(stats), dtype=int)
    counts = np.array([stats[c]["n"] for c in cells], dtype=np.int64)
    radii = np.array([stats[c]["r"] for c in cells], dtype=np.float64)
    norm = max((r["norm"] for r in stats.values()), default=0.0)
    return VectorIndex(placed, rings.drop("n", "norm"), C, cells, counts, radii, norm, ctype)


QUERY_BLOCK = 1 << 16    # query vectors that a region meets at a time
REGIONS = 16             # regions of an index, as long as one has no more than REGION_BLOCKS blocks
REGION_BLOCKS = 63       # bits of a mask


def search_index(queries: DataFrame, index: VectorIndex, k: int = SEARCH_K, qkey: str = "qid",
                 qvec: str = "qvec", ckey: str = "cid", query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact top-k of every query against a built index: ``qid, rank, cid, dist``.

    Queries stay a table. From the per-cell counts and radii every query gets an
    upper bound on its k-th distance, and from the bound the rings it can need:
    in a cell, the rows whose distance to the centroid lies between two values.
    A band join of these with the rings of the blocks says which blocks a query
    meets. Neighbouring blocks make a region, and a query is sent to a region
    once, with a mask of the blocks it meets there. A region meets its queries
    about ``query_block`` at a time: the task holds these, each with the k
    nearest so far, while the region's rows pass by block after block. So both
    queries and rows are copied a few times only (queries once for each region, rows once
    for each ``query_block`` queries), and a query leaves a region with k
    rows. A matrix product ranks the rows approximately, and every pair within the error bound
    of a query's k-th is recomputed exactly (summed left to right in float64,
    like the SQL twin). Unstructured vectors leave little to rule out: exact
    search then compares a query with most rows.
    """
    if not len(index.cells):
        return _no_hits(queries.sparkSession, dict(queries.dtypes)[qkey], index.ctype, qkey, ckey)
    return _search_blocks(_numbered(queries, qkey, qvec), index, k, qkey, ckey, query_block)


def _search_blocks(qs: DataFrame, index: VectorIndex, k: int, qkey: str, ckey: str, query_block: int) -> DataFrame:
    """Numbered queries against an index that is not empty."""
    ship_package(qs.sparkSession)
    ctype = index.ctype
    held = (index.centroids, index.cells, index.counts, index.radii, index.norm)
    bands = qs.select("n", "q").mapInArrow(_bands(held, k), "n bigint, cell int, low double, high double, tau double")
    size = min(max(math.ceil(int(index.counts.sum()) / BLOCK_ROWS / REGIONS), 1), REGION_BLOCKS)   # blocks of a region
    bit = F.pmod(F.col("block").bitwiseAND(0xFFFFFFFF), F.lit(size))
    rings = index.rings.select(F.col("cell").alias("_cell"), "r_min", "r_max", (F.col("block") - bit).alias("region"), bit.cast("int").alias("bit"))
    met = bands.join(rings, (F.col("cell") == F.col("_cell")) & (F.col("r_max") >= F.col("low")) & (F.col("r_min") <= F.col("high")))
    met = pinned(met.groupBy("n", "region").agg(F.first("tau").alias("tau"), F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")), "meetings")
    sizes = pinned(met.groupBy("region").agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts")), "parts")
    groups = sizes.agg(F.sum("parts")).head()[0] or 1
    asked = met.join(sizes, "region").withColumn("part", F.pmod(F.xxhash64("n"), "parts").cast("int")).join(qs, "n").select(
        "region", "part", F.lit(-1).alias("bit"), "n", "tau", "mask", "q")
    rows = index.data.withColumn("region", F.col("block") - bit).withColumn("bit", bit.cast("int")).join(sizes, "region").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("region", "part", "bit", "cid", "v")
    # a group's queries come before its rows
    both = asked.unionByName(rows, allowMissingColumns=True).repartition(int(groups), "region", "part").sortWithinPartitions("region", "part", "bit")
    return _ranked(both.mapInArrow(_meet(k), f"n bigint, cid {ctype}, dist double"), qs, k, qkey, ckey)


def _bands(held, k: int):
    """For each query and cell it can need: the distances to the centroid of the rows that may be among its k nearest."""
    import numpy as np
    import pyarrow as pa

    centroids, cells, counts, radii, norm = held

    def bands(batches):
        for part in (p for batch in batches for p in _slices(batch)):
            Q = _matrix(part.column(1)).astype(np.float64)
            err = np.sqrt(_slack(Q, centroids))[:, None]
            near = np.sqrt(_approx_sqdist(Q, centroids[cells]))
            lowest, highest = np.maximum(near - radii - err, 0.0), near + radii + err
            order = np.argsort(highest, axis=1, kind="stable")
            cum = np.cumsum(counts[order], axis=1)
            enough = cum[:, -1] >= k
            tau = np.where(enough, np.take_along_axis(highest, order, 1)[np.arange(len(Q)), (cum >= k).argmax(axis=1)], np.inf)
            tau = tau * (1 + 1e-9) + 1e-9
            qi, ci = np.nonzero(lowest <= tau[:, None])
            # the rows' own distances are widened by their error already; the same is allowed on the other side
            wide = tau + 2 * np.sqrt(2e-6 + 1e-9 * ((Q * Q).sum(1) + norm)) + err[:, 0]
            yield pa.record_batch({"n": part.column(0).to_numpy()[qi], "cell": cells[ci].astype("int32"), "low": near[qi, ci] - wide[qi],
                                   "high": near[qi, ci] + wide[qi], "tau": tau[qi]})

    return bands


class _Meeting:
    """Numbered queries, each with the k nearest of the rows seen so far that are within its bound."""

    def __init__(self, n, q, bound, k: int):
        import numpy as np

        self.n, self.q, self.bound, self.k = n, q, bound, k
        self.dist = np.full((len(self.n), k), np.inf)
        self.cid = np.full((len(self.n), k), None, object)

    def see(self, rows, asking) -> None:
        """``rows`` (at most a block) for the queries at ``asking``."""
        import numpy as np

        V = _matrix(rows.column("v")).astype(np.float64)
        cids = np.empty(len(V), object)
        cids[:] = rows.column("cid").to_pylist()
        finite = np.isfinite(V).all(axis=1)          # others have no distance, and would spoil the error bound of the rest
        if not finite.all():
            V, cids = V[finite], cids[finite]
        for first in range(0, len(asking) if len(V) else 0, BLOCK_ROWS):
            self._compare(asking[first:first + BLOCK_ROWS], V, cids, rows.schema.field("cid").type)

    def _compare(self, mine, V, cids, ctype) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        Q, last = self.q[mine].astype(np.float64), min(self.k, len(V)) - 1
        approx, margin = _approx_sqdist(Q, V), _slack(Q, V)
        limit = np.minimum(self.bound[mine], self.dist[mine, -1])
        near = (approx <= (limit + margin)[:, None]).any(axis=1)
        if not near.any():
            return
        mine, Q, approx, margin, limit = mine[near], Q[near], approx[near], margin[near], limit[near]
        approx[approx > (limit + margin)[:, None]] = np.inf
        kth = np.partition(approx, last, axis=1)[:, last]
        # finite only: with fewer than k candidates the k-th is infinite
        qi, vi = np.nonzero(np.isfinite(approx) & (approx <= (kth + margin)[:, None]))
        if not len(qi):
            return
        step = max((1 << 22) // V.shape[1], 1)                    # pairs whose vectors are copied at a time
        exact = np.concatenate([np.round(_seq_sqdist(Q[qi[s:s + step]], V[vi[s:s + step]]), 6) for s in range(0, len(qi), step)])
        keep = exact <= limit[qi]
        qi, vi, exact = qi[keep], vi[keep], exact[keep]
        if not len(qi):
            return
        # with what these queries hold, the k first by distance and id
        some = np.unique(qi)
        had_q, had_at = np.nonzero(np.isfinite(self.dist[mine[some]]))
        had_q = some[had_q]
        had_at = (mine[had_q], had_at)
        query, dist, cid = np.concatenate([qi, had_q]), np.concatenate([exact, self.dist[had_at]]), np.concatenate([cids[vi], self.cid[had_at]])
        by_id = np.empty(len(cid), np.int64)
        by_id[pc.sort_indices(pa.array(cid.tolist(), ctype), null_placement="at_start").to_numpy()] = np.arange(len(cid))
        order = np.lexsort((by_id, dist, query))
        query, dist, cid = query[order], dist[order], cid[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        top = rank < self.k
        at = (mine[query[top]], rank[top])
        self.dist[at], self.cid[at] = dist[top], cid[top]

    def found(self, ctype):
        import numpy as np
        import pyarrow as pa

        for first in range(0, len(self.n), 1 << 14):
            qi, at = np.nonzero(np.isfinite(self.dist[first:first + (1 << 14)]))
            at = (qi + first, at)
            yield pa.record_batch([pa.array(self.n[at[0]]), pa.array(self.cid[at].tolist(), ctype), pa.array(self.dist[at])], names=["n", "cid", "dist"])


def _meet(k: int):
    """Over rows sorted by region, part and bit, queries (bit -1) first: the k nearest rows of a region for each of its queries."""
    import numpy as np

    def meet(batches):
        current, asked, meeting, mask = None, [], None, None
        for batch in batches:
            ctype = batch.schema.field("cid").type
            keys = np.stack([batch.column(c).to_numpy() for c in ("region", "part", "bit")])
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if i == j:
                    continue
                region, part, bit = keys[:, i].tolist()
                if (region, part) != current:
                    if meeting is not None:
                        yield from meeting.found(ctype)
                    current, asked, meeting = (region, part), [], None
                if bit < 0:
                    asked.append(batch.slice(i, j - i).select(["n", "tau", "mask", "q"]))
                    continue
                if meeting is None and asked:
                    n, mask, tau = (np.concatenate([b.column(c).to_numpy() for b in asked]) for c in ("n", "mask", "tau"))
                    meeting, asked = _Meeting(n, np.concatenate([_matrix(b.column("q")) for b in asked]), tau ** 2 * (1 + 1e-9) + 1e-9, k), []
                if meeting is not None:
                    asking = np.flatnonzero(mask >> bit & 1)
                    for rows in _slices(batch.slice(i, j - i).select(["cid", "v"])) if len(asking) else ():
                        meeting.see(rows, asking)
        if meeting is not None:
            yield from meeting.found(ctype)

    return meet


def search(queries: DataFrame, chunks: DataFrame, k: int = SEARCH_K, ids: "DataFrame | list | None" = None,
           qkey: str = "qid", qvec: str = "qvec", ckey: str = "cid", cvec: str = "embedding",
           chash: str = "content_hash", n_cells: int | None = None, max_cells: int = 1024,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact k nearest chunks per query by squared L2, restricted to ``ids``.

    Result: ``qid, rank, cid, dist`` with ``dist`` rounded to 6 digits, ties by
    id: ``build_index`` then ``search_index``
    (build the index once and search it many times when queries come in
    batches). Where the queries are fewer than the cells the index would have,
    placing a chunk would compare it with more centroids than there are
    queries: each chunk is then compared with the queries where it lies, and
    only the k nearest of each task are sent on. Distances are computed in numpy blocks: Spark 4.1 has no vector
    functions and higher-order lambdas run interpreted.
    """
    cand = _selected(chunks, ids, ckey, cvec, chash)
    n_cells = n_cells if n_cells is not None else _cells(cand, max_cells)
    qs = _numbered(queries, qkey, qvec)
    if qs.count() < n_cells:
        return _search_rows(qs, cand, k, qkey, ckey)
    index = build_index(chunks, ids, ckey, cvec, chash, n_cells, max_cells)
    if not len(index.cells):
        return _no_hits(qs.sparkSession, dict(qs.dtypes)["qid"], index.ctype, qkey, ckey)
    return _search_blocks(qs, index, k, qkey, ckey, query_block)


def _search_rows(qs: DataFrame, cand: DataFrame, k: int, qkey: str, ckey: str) -> DataFrame:
    """Every candidate row against fewer queries than an index has centroids; they ship to the tasks as the centroids would."""
    import numpy as np

    spark, ctype = qs.sparkSession, dict(cand.dtypes)["cid"]
    ship_package(spark)
    held = qs.select("n", "q").toArrow().combine_chunks()
    if not held.num_rows:
        return _no_hits(spark, dict(qs.dtypes)["qid"], ctype, qkey, ckey)
    n, Q = held.column("n").to_numpy(), _matrix(held.column("q").combine_chunks())

    def nearest(batches):
        meeting, everyone = _Meeting(n, Q, np.full(len(n), np.inf), k), np.arange(len(n))
        for batch in batches:
            for rows in _slices(batch):
                meeting.see(rows, everyone)
            kind = batch.schema.field("cid").type
        if np.isfinite(meeting.dist).any():
            yield from meeting.found(kind)

    return _ranked(cand.mapInArrow(nearest, f"n bigint, cid {ctype}, dist double"), qs, k, qkey, ckey)


# D8 ------------------------------------------------------------------------
def ids_for_titles(titles: DataFrame, library_titles: DataFrame, title_col: str = "title",
                   nearest: bool = False, encoder=None) -> DataFrame:
    """Content hash for each selected title.

    By default an exact match (equality join). With ``nearest`` every title is
    embedded (D6) and mapped to the library title nearest to it (D7 with k=1),
    as a vector store lookup with one result does.
    """
    if not nearest:
        return titles.select(title_col).join(library_titles.select(title_col, "content_hash"), title_col)
    lib = library_titles.select(title_col, "content_hash").dropDuplicates(["content_hash"])
    lib_vecs = embed(lib, "content_hash", title_col, encoder=encoder)
    sel = titles.select(title_col).distinct()
    q = embed(sel, title_col, title_col, encoder=encoder).select(F.col(title_col).alias("qid"),
                                                                  F.col("embedding").alias("qvec"))
    hits = search(q, lib_vecs.select(F.col("content_hash").alias("cid"), "embedding",
                                     F.col("content_hash").alias("content_hash")), k=1)
    return hits.select(F.col("qid").alias(title_col), F.col("cid").alias("content_hash"))


# D9 ------------------------------------------------------------------------
def assemble_context(hits: DataFrame, qkey: str = "qid", rank: str = "rank", text: str = "text",
                     source: str = "source") -> DataFrame:
    """Per query, ``text + "\\n [Source: " + source + "]\\n"`` joined in rank order.

    A group holds at most k hits, so collecting it is bounded.
    """
    piece = F.concat(F.col(text), F.lit(SOURCE_OPEN), F.col(source), F.lit(SOURCE_CLOSE))
    return hits.groupBy(qkey).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), piece.alias("t")))),
                                 lambda s: s["t"]), "").alias("context"))


# D10 -----------------------------------------------------------------------
def list_library(library_titles: DataFrame) -> DataFrame:
    """Titles in the library."""
    return library_titles.select("title").distinct()
