"""Structured Streaming versions of the two append paths and of the chain runner.

All queries checkpoint under the session's shared checkpoint folder, so a
restarted or retried job resumes where it stopped; every sink write is
idempotent (a micro-batch writes its own folder, or skips keys already stored).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN_CHARS, content_hash
from tessera.operators import library as L
from tessera.operators import memory as M
from tessera.session import pinned, scratch_path
from tessera.sources.keyed import KeyedStore

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TURN_SCHEMA = "conv_id long, turn long, role string, text string"
LIBRARY_SCHEMA = "chunk_id string, chunk_no int, text string, source string, content_hash string, embedding array<float>"
LIBRARY_FOLDERS = 64
COMPACT_EVERY = 16       # micro-batches


def library_store(spark: SparkSession, library: str) -> KeyedStore:
    """The chunks of a library by document and number, the chunks of a document in one folder."""
    return KeyedStore(spark, f"{library}/chunks", LIBRARY_SCHEMA, ("content_hash", "chunk_no"), ("content_hash",), LIBRARY_FOLDERS)


def read_library(spark: SparkSession, library: str) -> DataFrame:
    """Chunk rows of a library written by ``stream_documents``."""
    return library_store(spark, library).read()


def read_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files below ``path`` as a stream. A ``glob`` filters their names; one without wildcards names a table right
    below ``path``, which may be a file or a folder of files."""
    r = spark.readStream.format("parquet").schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if glob and any(c in glob for c in "*?[]{}\\"):
        r = r.option("pathGlobFilter", glob)
    elif glob:
        # a pattern that only this name matches: a plain path is taken as a folder of partitions, which a file is not
        path = f"{path.rstrip('/')}/{glob[:-1]}[{glob[-1]}]"
    return r.load(path)


def _run(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# L1 ------------------------------------------------------------------------
def stream_documents(spark: SparkSession, src: str, library: str, glob: str | None = None,
                     checkpoint: str | None = None, max_files: int | None = None, encoder=None,
                     encoder_factory=None) -> None:
    """L1: new document files -> embedded chunk library, deduplicated by content hash.

    Each micro-batch keeps the first document per hash, drops hashes already in
    the library, of which only the folders of the batch's hashes are read, and
    adds its chunks. A retried batch finds its documents there. Every
    ``COMPACT_EVERY`` batches the small files are merged.
    """
    docs = read_stream(spark, src, DOC_SCHEMA, glob, max_files)
    store = library_store(spark, library)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        hashes = batch.select(content_hash("text").alias("content_hash"))
        # written once: the chunks are embedded and joined to their vectors
        new = pinned(L.chunk_documents(L.ingest_documents(L.with_title(batch), store.read(hashes).select("content_hash"))), "chunks")
        new = new.join(L.embed(new, "chunk_id", "text", encoder=encoder, encoder_factory=encoder_factory), "chunk_id")
        store.add(new, unique=True)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            store.compact()

    _run(docs.writeStream.foreachBatch(per_batch), checkpoint or scratch_path(spark, "ckpt-docs"))


# L2 ------------------------------------------------------------------------
def stream_turns(spark: SparkSession, src: str, memory: str, glob: str | None = None,
                 checkpoint: str | None = None, max_files: int | None = None) -> None:
    """L2: conversation rows -> memory table of raw turns, idempotent by
    (user, session, turn).

    The stream stores rows, not pairs: a prompt and its answer may arrive in
    different micro-batches, so pairs are formed when the memory is read
    (``read_turn_pairs``), where every stored row is visible. Rows already
    stored, and repeats inside a batch, are skipped, so a retried batch adds nothing.
    """
    rows = read_stream(spark, src, TURN_SCHEMA, glob, max_files)
    store = raw_turns(spark, memory)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        store.add(M.conversation_turns(batch))

    _run(rows.writeStream.foreachBatch(per_batch), checkpoint or scratch_path(spark, "ckpt-turns"))


RAW_TURNS = "session_id string, ts timestamp, conv_id long, turn long, role string, text string, user_id string"


def raw_turns(spark: SparkSession, memory: str) -> KeyedStore:
    """The table of raw turns by (user, session, turn), the turns of a session in one folder."""
    return KeyedStore(spark, memory, RAW_TURNS, (*M.SESSION, "turn"), tuple(M.SESSION))


def read_turn_pairs(spark: SparkSession, memory: str) -> DataFrame:
    """Tagged (prompt, answer) turns of a raw-turn memory table (F7 then F1's tags)."""
    rows = raw_turns(spark, memory).read()
    return M.tag_turns(M.chat_pairs(rows))


# L3 ------------------------------------------------------------------------
LIVE_SCHEMA = ("user_id string, session_id string, turn long, ts timestamp, role string, len long, suffix_chars long, "
               "version long")
LIVE_FOLDERS = 64


def live_store(spark: SparkSession, out: str) -> KeyedStore:
    """The rows that live memory holds: a session's latest version is its memory, older ones go when files are merged."""
    return KeyedStore(spark, out, LIVE_SCHEMA, (*M.SESSION, "version", "turn"), tuple(M.SESSION), LIVE_FOLDERS)


def latest_rows(rows: DataFrame) -> DataFrame:
    """The rows of every session's latest version; null keys are sessions of their own."""
    newest = rows.groupBy(*M.SESSION).agg(F.max("version").alias("_newest"))
    newest = newest.select(*[F.col(c).alias(f"_{c}") for c in M.SESSION], "_newest")
    same = (F.col("version") == F.col("_newest"))
    for c in M.SESSION:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(newest, same, "left_semi")


def current_memory(rows: DataFrame) -> DataFrame:
    """The turns that each session's memory keeps: user_id, session_id, ts, suffix_chars."""
    return latest_rows(rows).filter(F.col("suffix_chars").isNotNull()).select(*M.SESSION, "ts", "suffix_chars")


def fold_turns(store: KeyedStore, rows: DataFrame, max_tok: float) -> DataFrame:
    """The next version of every session that has new ``rows`` (turn, ts, role, len): what it held, with the new rows in
    their places, cut to the newest pairs that fit ``max_tok`` (F3). A row given again replaces itself.

    A pair is a user's row with the next number's row, where that is the assistant's. Rows before the oldest kept pair can
    never come back, since costs only grow; a session that keeps none leaves a row without a number. What a session
    holds is bounded by the budget, so a window over it is too.
    """
    new = rows.groupBy(*M.SESSION, "turn").agg(F.max(F.struct("ts", "role", "len")).alias("r")).select(
        *M.SESSION, "turn", "r.*", F.lit(True).alias("new"), F.lit(None).cast("long").alias("version"))
    held = latest_rows(store.matching(rows)).select(*M.SESSION, "turn", "ts", "role", "len", F.lit(False).alias("new"), "version")
    whole = Window.partitionBy(*M.SESSION)
    placed = new.unionByName(held).withColumn("version", F.coalesce(F.max("version").over(whole), F.lit(0)) + 1)
    again = Window.partitionBy(*M.SESSION, "turn").orderBy(F.col("new").desc())
    placed = placed.where(F.col("turn").isNotNull()).withColumn("nth", F.row_number().over(again)).where("nth = 1")
    order = whole.orderBy("turn")
    follows = (F.lead("turn").over(order) == F.col("turn") + 1) & (F.lead("role").over(order) == "assistant")
    answer = F.when(follows, F.lead("len").over(order)).otherwise(F.lit(0))
    costs = placed.withColumn("cost", F.when(F.col("role") == "user", F.col("len") + answer + 2))
    newest = whole.orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    costs = costs.withColumn("suffix_chars", F.when(F.col("cost").isNotNull(), F.sum("cost").over(newest)))
    kept = F.col("suffix_chars") / F.lit(TOKEN_CHARS) <= F.lit(float(max_tok))
    oldest = F.coalesce(F.min(F.when(kept, F.col("turn"))).over(whole), F.max(F.when(F.col("cost").isNotNull(), F.col("turn"))).over(whole) + 1,
                        F.min("turn").over(whole))
    cut = costs.withColumn("suffix_chars", F.when(kept, F.col("suffix_chars"))).withColumn("oldest", oldest)
    left = cut.where(F.col("turn") >= F.col("oldest"))
    gone = cut.groupBy(*M.SESSION, "version").agg(F.max("turn").alias("last"), F.first("oldest").alias("oldest")).where("last < oldest")
    columns = store.columns
    return left.select(*columns).unionByName(gone.select(*M.SESSION, "version"), allowMissingColumns=True).select(*columns)


def _stream_live(rows: DataFrame, out: str, max_tok: float, checkpoint: str | None) -> DataFrame:
    spark = rows.sparkSession
    store = live_store(spark, out)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        store.add(fold_turns(store, pinned(batch, "turns"), max_tok), unique=True)
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            store.compact(keep=latest_rows)

    _run(rows.writeStream.foreachBatch(per_batch), checkpoint or scratch_path(spark, "ckpt-mem"))
    return current_memory(store.read())


def stream_memory(pairs: DataFrame, out: str, max_tok: float, checkpoint: str | None = None) -> DataFrame:
    """L3: live sliding memory per session, in a store that holds only the turns that fit.

    ``pairs`` is a stream of turn rows (``user_id, session_id, ts,
    user_prompt, llm_answer``), e.g. the memory table written by L2. A
    micro-batch reads the sessions it touches, of which only their folders,
    and adds their next version; late turns sort into place by time, replayed
    ones replace themselves. There is no streaming state that idle sessions
    could fill, and older versions go when files are merged.
    """
    costs = pairs.select(*M.SESSION, F.unix_micros("ts").alias("turn"), "ts", F.lit("user").alias("role"),
                         (M.turn_cost() - 2).cast("long").alias("len"))
    return _stream_live(costs, out, max_tok, checkpoint)


def stream_memory_from_turns(spark: SparkSession, src: str, out: str, max_tok: float, glob: str | None = None,
                             checkpoint: str | None = None, max_files: int | None = None) -> DataFrame:
    """L3 over raw conversation rows: live sliding memory per session.

    Prompts and answers may arrive in any micro-batch: the store keeps the raw
    rows from a session's oldest kept pair on, pairs are formed from them each
    time, so a late answer lengthens its pair and may push older turns out.
    """
    rows = M.conversation_turns(read_stream(spark, src, TURN_SCHEMA, glob, max_files))
    rows = rows.select(*M.SESSION, "turn", "ts", "role", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("len"))
    return _stream_live(rows, out, max_tok, checkpoint)


# L4 ------------------------------------------------------------------------
def stream_chain(prompts_stream: DataFrame, steps, ctx, out: str, prompt_col: str = "prompt",
                 checkpoint: str | None = None) -> None:
    """L4: the chain runner on a streaming DataFrame (row-wise actions only)."""
    from tessera.plans.chain import run_chain

    res = run_chain(prompts_stream, steps, ctx, prompt_col)
    _run(res.writeStream.format("parquet").option("path", out),
         checkpoint or scratch_path(prompts_stream.sparkSession, "ckpt-chain"))
