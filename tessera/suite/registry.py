"""All fixture queries, keyed by operator id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import library as L
from tessera.suite.common import T


def flagship(spark, sf_dir):
    """Chunk library per language: documents -> hash -> dedupe -> sentences -> chunks."""
    docs = L.with_title(T(spark, sf_dir, "documents"))
    lib = L.ingest_documents(docs, None)
    chunks = L.chunk_documents(lib, keep=("lang",))
    return chunks.groupBy("lang").agg(
        F.countDistinct("content_hash").alias("n_documents"),
        F.count("*").alias("n_chunks"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"),
    )




def all_queries():
    from tessera.suite import ask_q, chain_q, io_q, library_q, memory_q, pages_q, text_q

    out = {}
    for mod in (library_q, memory_q, ask_q, text_q, pages_q, chain_q, io_q):
        out.update(mod.QUERIES)
    return out
