"""Fixture queries: sources and sinks (A1-A6) and streams (L1-L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import content_hash
from tessera.operators import library as L
from tessera.operators import memory as M
from tessera.plans import chain as G
from tessera.session import read_table, scratch_path
from tessera.sources import tables as A
from tessera.streaming import streams as S
from tessera.suite import chain_q, library_q, memory_q
from tessera.suite.common import T


def a1_read_table(spark, sf):
    path = scratch_path(spark, "customer-csv")
    T(spark, sf, "customer").write.option("header", True).option("sep", ";").csv(path)
    c = A.read_table(spark, path, sep=";")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("acctbal"))


A1_SQL = ("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS acctbal FROM customer "
          "GROUP BY c_mktsegment")


def _step_rows(spark, sf):
    """Step tables derived from conversations: one table per conversation, one step per turn."""
    from pyspark.sql import Window

    r = T(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return r.select(
        F.col("conv_id").alias("recipe"), F.col("turn").alias("step_no"),
        # separators, quotes and line breaks stay; half of the texts get more of them
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(
            F.concat("text", F.lit(' | "quoted|", '), "role", F.lit('\n"end'))).alias("input"),
        F.when(F.col("role") == "user", "llm_completion").when(F.col("role") == "assistant", "user_input")
        .otherwise("csv_peek").alias("action"),
        F.when(F.col("role") == "user", F.lit("{'max_length': 64}")).otherwise(F.lit("")).alias("option"),
        F.when(F.lead("turn").over(w).isNull(), F.lit("default")).otherwise(F.lit("next"))
        .alias("next_df"))


def a2_read_sequences(spark, sf):
    path = scratch_path(spark, "sequences")
    A.write_sequences(_step_rows(spark, sf), path)
    seq = A.read_sequences(spark, path, glob="*.txt")
    return seq.select(F.regexp_extract("file", r"recipe=(\d+)", 1).cast("bigint").alias("recipe"),
                      F.col("step_no").cast("bigint").alias("step_no"), F.md5("input").alias("input_md5"),
                      "action", "option", "next_df")


A2_SQL = r"""SELECT conv_id AS recipe, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS step_no,
  md5(trim(CASE WHEN turn % 2 = 0 THEN text ELSE text || ' | "quoted|", ' || role || chr(10) || '"end' END)) AS input_md5,
  CASE WHEN role = 'user' THEN 'llm_completion' WHEN role = 'assistant' THEN 'user_input' ELSE 'csv_peek' END AS action,
  CASE WHEN role = 'user' THEN '{''max_length'': 64}' ELSE '' END AS option,
  CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 'default'
       ELSE 'next' END AS next_df
FROM conversations"""


def g1_compile_steps(spark, sf):
    path = scratch_path(spark, "sequences")
    A.write_sequences(_step_rows(spark, sf), path)
    steps = G.compile_steps(A.read_sequences(spark, path, glob="*.txt"))
    return steps.select(F.regexp_extract("file", r"recipe=(\d+)", 1).cast("bigint").alias("recipe"),
                        F.col("step_no").cast("bigint").alias("step_no"), "action", "known",
                        F.col("options")["max_length"].cast("bigint").alias("max_length"),
                        F.size("options").cast("bigint").alias("n_options"))


G1_SQL = r"""SELECT conv_id AS recipe, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS step_no,
  CASE WHEN role = 'user' THEN 'llm_completion' WHEN role = 'assistant' THEN 'user_input' ELSE 'csv_peek' END AS action,
  true AS known,
  CASE WHEN role = 'user' THEN 64 END::BIGINT AS max_length,
  CASE WHEN role = 'user' THEN 1 ELSE 0 END::BIGINT AS n_options
FROM conversations"""


def a3_decode_documents(spark, sf):
    d = T(spark, sf, "documents")
    enc = (F.when(F.col("lang") == "en", F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
           .when(F.col("lang") == "de", F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
           .otherwise(F.encode("text", "UTF-8")))
    dec = A.decode_text(enc)
    return d.select("doc_id", F.md5(dec).alias("text_md5"), F.length(dec).cast("bigint").alias("n_chars"))


A3_SQL = "SELECT doc_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM documents"


def a4_save_result(spark, sf):
    store = scratch_path(spark, "results")
    res = T(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"),
                                                               F.round(F.sum("l_quantity"), 2).alias("qty"))
    A.save_result(res, store, "by_flag")
    A.save_result(res, store, "by_flag")  # saving again replaces, not doubles
    return A.load_result(spark, store, "by_flag", view=None)


A4_SQL = "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag"


def a5_load_result(spark, sf):
    store = scratch_path(spark, "results")
    per_order = T(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    A.save_result(per_order, store, "per_order")
    A.load_result(spark, store, "per_order", view="df")
    return spark.sql("SELECT CAST(floor(qty / 50) AS BIGINT) AS bucket, count(*) AS n_orders FROM df GROUP BY 1")


A5_SQL = ("SELECT CAST(floor(qty / 50) AS BIGINT) AS bucket, count(*) AS n_orders FROM "
          "(SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) GROUP BY 1")


def a6_append(spark, sf):
    store = scratch_path(spark, "tables")
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    A.append(o, store, "orders_log")
    path = A.append(o, store, "orders_log")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


A6_SQL = "SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY o_orderstatus"


def l1_stream_documents(spark, sf):
    lib = scratch_path(spark, "library")
    S.stream_documents(spark, sf, lib, glob="documents.parquet")
    ch = S.read_library(spark, lib)
    return ch.select("chunk_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "source", "content_hash",
                     F.length("text").cast("bigint").alias("n_chars"))


def l2_stream_turns(spark, sf):
    mem = scratch_path(spark, "memory")
    S.stream_turns(spark, sf, mem, glob="conversations.parquet")
    m = S.read_turn_pairs(spark, mem)
    return m.select(*M.SESSION, "ts", F.md5("user_prompt").alias("prompt_md5"),
                    F.md5("llm_answer").alias("answer_md5"))


def l3_stream_memory(spark, sf):
    src = scratch_path(spark, "pairs")
    memory_q._pairs(spark, sf).write.parquet(src)
    pairs = spark.readStream.schema("user_id string, session_id string, ts timestamp, user_prompt string, "
                                    "llm_answer string").parquet(src)
    cur = S.stream_memory(pairs, scratch_path(spark, "live-memory"), memory_q.F3_BUDGET)
    return cur.select(*M.SESSION, "ts", "suffix_chars")


def l3_stream_memory_from_turns(spark, sf):
    """Live sliding memory straight from the conversations table read as a stream."""
    cur = S.stream_memory_from_turns(spark, sf, scratch_path(spark, "live-memory"), memory_q.F3_BUDGET,
                                     glob="conversations.parquet")
    return cur.select(*M.SESSION, "ts", "suffix_chars")


def l4_stream_chain(spark, sf):
    out = scratch_path(spark, "chain-out")
    stream = S.read_stream(spark, sf, S.TURN_SCHEMA, "conversations.parquet")
    prompts = stream.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("prompt"))
    S.stream_chain(prompts, chain_q.THREE_STEPS, chain_q._ctx(spark), out)
    return spark.read.schema("row_id long, result string").parquet(out).select("row_id", F.md5("result").alias("result_md5"))


QUERIES = {
    "A1_read_table": (a1_read_table, A1_SQL),
    "A2_read_sequences": (a2_read_sequences, A2_SQL),
    "A3_decode_documents": (a3_decode_documents, A3_SQL),
    "G1_compile_steps": (g1_compile_steps, G1_SQL),
    "A4_save_result": (a4_save_result, A4_SQL),
    "A5_load_result": (a5_load_result, A5_SQL),
    "A6_append": (a6_append, A6_SQL),
    "L1_stream_documents": (l1_stream_documents, library_q.D3_SQL),
    "L2_stream_turns": (l2_stream_turns, memory_q.F1_SQL),
    "L3_stream_memory": (l3_stream_memory, memory_q.F3_SQL),
    "L3_stream_memory_from_turns": (l3_stream_memory_from_turns, memory_q.F3_SQL),
    "L4_stream_chain": (l4_stream_chain, chain_q.G2_SQL),
}
