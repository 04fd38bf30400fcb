from pyspark.sql import functions as F

from tessera.operators import library as L
from tessera.session import scratch_path
from tessera.streaming import streams as S
from tests.conftest import SF


def test_stream_documents_dedupes_across_batches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src = scratch_path(spark, "doc-src")
    # two files, one per micro-batch; the second repeats documents of the first
    docs.filter("doc_id < 120").coalesce(1).write.parquet(f"{src}/a")
    docs.filter("doc_id >= 60").coalesce(1).write.parquet(f"{src}/b")
    lib = scratch_path(spark, "library")
    for part in ("a", "b"):
        S.stream_documents(spark, f"{src}/{part}", lib, checkpoint=f"{lib}-ckpt-{part}")
    got = S.read_library(spark, lib).select("content_hash").distinct().count()
    want = docs.select(F.md5("text")).distinct().count()
    assert got == want
    # the batch chunking of the whole table gives the same chunk rows
    once = L.chunk_documents(L.ingest_documents(L.with_title(docs), None)).select("chunk_id").distinct().count()
    assert S.read_library(spark, lib).select("chunk_id").distinct().count() == once


def test_stream_retry_is_idempotent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src = scratch_path(spark, "doc-src")
    docs.coalesce(1).write.parquet(src)
    lib = scratch_path(spark, "library")
    S.stream_documents(spark, src, lib, checkpoint=f"{lib}-ckpt")
    n = S.read_library(spark, lib).count()
    S.stream_documents(spark, src, lib, checkpoint=f"{lib}-ckpt")     # restart: nothing new
    assert S.read_library(spark, lib).count() == n


def test_stream_turns_pairs_across_batches(spark):
    from tessera.operators import memory as M

    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    src = scratch_path(spark, "turn-src")
    # answers arrive in a later micro-batch than their prompts
    conv.filter("role <> 'assistant'").coalesce(1).write.parquet(f"{src}/a")
    conv.filter("role = 'assistant'").coalesce(1).write.parquet(f"{src}/b")
    mem = scratch_path(spark, "memory")
    for part in ("a", "b"):
        S.stream_turns(spark, f"{src}/{part}", mem, checkpoint=f"{mem}-ckpt-{part}")
    S.stream_turns(spark, f"{src}/a", mem, checkpoint=f"{mem}-ckpt-again")   # replayed input adds nothing
    got = S.read_turn_pairs(spark, mem).select(*M.SESSION, "ts", "user_prompt", "llm_answer")
    want = M.tag_turns(M.chat_pairs(M.conversation_turns(conv))).select(*M.SESSION, "ts", "user_prompt", "llm_answer")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_streamed_library_is_searchable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    src = scratch_path(spark, "doc-src")
    docs.coalesce(1).write.parquet(src)
    lib = scratch_path(spark, "library")
    S.stream_documents(spark, src, lib, checkpoint=f"{lib}-ckpt")
    chunks = S.read_library(spark, lib)
    q = L.embed(chunks.limit(3).select("chunk_id", "text"), "chunk_id", "text").select(
        F.col("chunk_id").alias("qid"), F.col("embedding").alias("qvec"))
    hits = L.search(q, chunks.select(F.col("chunk_id").alias("cid"), "embedding", "content_hash"), k=1)
    assert all(h.dist == 0.0 for h in hits.collect())     # each chunk finds an identical vector


def test_live_memory_from_turns_with_late_answers(spark):
    from tessera.operators import memory as M

    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    src = scratch_path(spark, "turn-src")
    conv.filter("role <> 'assistant'").coalesce(1).write.parquet(src)                  # prompts first
    conv.filter("role = 'assistant'").coalesce(1).write.mode("append").parquet(src)    # answers later
    out, ckpt = scratch_path(spark, "live"), scratch_path(spark, "ckpt-live")
    S.stream_memory_from_turns(spark, src, out, 120, checkpoint=ckpt, max_files=1)
    got = S.current_memory(spark.read.parquet(out)).select(*M.SESSION, "ts", "suffix_chars")
    want = M.sliding_memory(M.chat_pairs(M.conversation_turns(conv)), 120).select(*M.SESSION, "ts", "suffix_chars")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_library_files_are_merged(spark, monkeypatch):
    import glob

    monkeypatch.setattr(S, "COMPACT_EVERY", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    src, lib = scratch_path(spark, "doc-src"), scratch_path(spark, "library")
    docs.repartition(12).write.parquet(src)
    S.stream_documents(spark, src, lib, checkpoint=f"{lib}-ckpt", max_files=1)
    path = S.library_store(spark, lib).path.replace("file:", "")
    folders = glob.glob(f"{path}/bucket=*")
    assert len(folders) <= S.LIBRARY_FOLDERS and len(glob.glob(f"{path}/bucket=*/*.parquet")) <= 12 * len(folders)
    S.library_store(spark, lib).compact(files=1)
    assert len(glob.glob(f"{path}/bucket=*/*.parquet")) == len(folders)
    assert S.read_library(spark, lib).select("content_hash").distinct().count() == docs.select(F.md5("text")).distinct().count()


def test_live_memory_replays_and_storage(spark, monkeypatch):
    from tessera.operators import memory as M

    monkeypatch.setattr(S, "COMPACT_EVERY", 4)
    src, out = scratch_path(spark, "turn-src"), scratch_path(spark, "live")
    rows = [(conv, turn, "user" if turn % 2 == 0 else "assistant", "x" * (5 + turn % 3)) for turn in range(40) for conv in (1, 2, None)]
    for turn in range(40):                                       # one file, and so one batch, for each turn
        spark.createDataFrame([r for r in rows if r[1] == turn], S.TURN_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    S.stream_memory_from_turns(spark, src, out, 12, checkpoint=f"{out}-one", max_files=4)
    store = S.live_store(spark, out)
    pairs = M.chat_pairs(M.conversation_turns(spark.createDataFrame(rows, S.TURN_SCHEMA)))
    want = sorted(map(tuple, M.sliding_memory(pairs, 12).select(*M.SESSION, "ts", "suffix_chars").collect()), key=str)
    now = lambda: sorted(map(tuple, S.current_memory(store.read()).collect()), key=str)
    assert now() == want and len(want) > 4
    S.stream_memory_from_turns(spark, src, out, 12, checkpoint=f"{out}-two", max_files=20)      # the same input again
    assert now() == want
    store.compact(files=0, keep=S.latest_rows)
    assert now() == want and store.read().groupBy(*M.SESSION).agg(F.countDistinct("version").alias("n")).where("n > 1").count() == 0
    assert store.read().count() < 40


def test_live_memory_that_fits_nothing(spark):
    src, out = scratch_path(spark, "turn-src"), scratch_path(spark, "live")
    for batch in ([(1, 0, "user", "x" * 10)], [(1, 1, "user", "y" * 900)], [(1, 3, "assistant", "z")]):
        spark.createDataFrame(batch, S.TURN_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = S.stream_memory_from_turns(spark, src, out, 20, checkpoint=f"{out}-ckpt")
        kept = [r.suffix_chars for r in got.collect()]
        assert kept == ([12] if len(batch) and batch[0][1] == 0 else [])


def test_streams_read_tables_that_are_folders(spark):
    from tessera.suite import io_q

    src = scratch_path(spark, "tables")
    spark.read.parquet(f"{SF}/conversations.parquet").repartition(3).write.parquet(f"{src}/conversations.parquet")
    for query in (io_q.l4_stream_chain, io_q.l2_stream_turns):
        want, got = query(spark, SF), query(spark, src)
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_stream_chain_over_an_empty_table(spark):
    from tessera.suite import io_q

    src = scratch_path(spark, "tables")
    spark.createDataFrame([], S.TURN_SCHEMA).write.parquet(f"{src}/conversations.parquet")
    assert io_q.l4_stream_chain(spark, src).collect() == []
