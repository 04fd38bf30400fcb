"""Fixture queries for the document library (D1-D10) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import content_hash, sentences
from tessera.operators import library as L
from tessera.session import pinned
from tessera.suite.common import T, d_bucket, d_pack, d_sentences, d_sqdist, d_title, d_tokens


def _docs(spark, sf):
    return L.with_title(T(spark, sf, "documents"))


def _library(spark, sf):
    """Library = the whole documents table ingested into an empty store."""
    return L.ingest_documents(_docs(spark, sf), None)


def d1_sentences(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", F.posexplode(sentences("text")).alias("pos", "s"))
    return d.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("sent_no"),
                    F.length("s").cast("bigint").alias("n_chars"), F.md5("s").alias("sent_md5"))


D1_SQL = f"""
WITH s AS (SELECT doc_id, {d_sentences('text')} AS l FROM documents),
e AS (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM s)
SELECT doc_id, i::BIGINT AS sent_no, length(l[i])::BIGINT AS n_chars, md5(l[i]) AS sent_md5 FROM e
"""


def d2_pack_chunks(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", F.posexplode(L.pack_chunks(sentences("text"))).alias("pos", "c"))
    return d.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("chunk_no"),
                    F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("chunk_md5"))


D2_SQL = f"""
WITH s AS (SELECT doc_id, {d_sentences('text')} AS l FROM documents),
p AS (SELECT doc_id, {d_pack('l')} AS c FROM s),
e AS (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM p)
SELECT doc_id, i::BIGINT AS chunk_no, length(c[i])::BIGINT AS n_chars, md5(c[i]) AS chunk_md5 FROM e
"""

# ingest: first document (lowest doc_id) of each content hash
_FIRST = f"""h AS (SELECT *, md5(text) AS content_hash, {d_title()} AS title FROM documents),
firsts AS (SELECT content_hash, min(doc_id) AS doc_id FROM h GROUP BY content_hash),
lib AS (SELECT h.* FROM h JOIN firsts USING (content_hash, doc_id))"""


def d3_chunk_rows(spark, sf):
    ch = L.chunk_documents(_library(spark, sf))
    return ch.select("chunk_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "source", "content_hash",
                     F.length("text").cast("bigint").alias("n_chars"))


D3_SQL = f"""
WITH {_FIRST},
s AS (SELECT content_hash, title, {d_sentences('text')} AS l FROM lib),
p AS (SELECT content_hash, title, {d_pack('l')} AS c FROM s),
e AS (SELECT content_hash, title, c, unnest(generate_series(1, len(c))) AS i FROM p)
SELECT content_hash || '_chunk' || CAST(i AS VARCHAR) AS chunk_id, i::BIGINT AS chunk_no, title AS source,
       content_hash, length(c[i])::BIGINT AS n_chars FROM e
"""


def d4_ingest_new(spark, sf):
    docs = _docs(spark, sf)
    held = docs.filter(F.col("lang") == "en").select(content_hash("text").alias("content_hash"))
    new = L.ingest_documents(docs, held)
    return new.select("doc_id", "content_hash", "title")


D4_SQL = f"""
WITH {_FIRST}
SELECT doc_id, content_hash, title FROM lib
WHERE content_hash NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en')
"""


def d5_ingest_status(spark, sf):
    docs = _docs(spark, sf)
    held = docs.filter(F.col("lang") == "en").select(content_hash("text").alias("content_hash"))
    return L.ingest_status(docs, held)


D5_SQL = f"""
WITH {_FIRST},
held AS (SELECT DISTINCT md5(text) AS content_hash FROM documents WHERE lang = 'en'),
st AS (SELECT h.doc_id, h.content_hash, h.title,
              (h.doc_id = f.doc_id AND h.content_hash NOT IN (SELECT content_hash FROM held)) AS added
       FROM h JOIN firsts f USING (content_hash))
SELECT doc_id, content_hash,
       CASE WHEN added THEN 'added' ELSE 'existing' END AS status,
       CASE WHEN added THEN 'Document' || title || 'added to collection and embedded'
            ELSE 'Document ' || title || ' is already existing in the collection and loaded' END AS message
FROM st
"""


def d6_embed(spark, sf):
    e = L.embed(T(spark, sf, "documents"), "doc_id", "text")
    e = e.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter(F.col("w") != 0)
    return e.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"),
                    F.round(F.col("w").cast("double"), 6).alias("weight"))


def _d_embed_counts(src: str, key: str, text: str) -> str:
    return f"""t_{key} AS (SELECT {key}, unnest({d_tokens(text)}) AS tok FROM {src}),
c_{key} AS (SELECT {key}, {d_bucket('tok')} AS b, count(*) AS n FROM t_{key} GROUP BY ALL),
n_{key} AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM c_{key} GROUP BY {key})"""


D6_SQL = f"""
WITH {_d_embed_counts('documents', 'doc_id', 'text')}
SELECT doc_id, b::BIGINT AS bucket, round(((n / norm)::FLOAT)::DOUBLE, 6) AS weight
FROM c_doc_id JOIN n_doc_id USING (doc_id)
"""


def d7_search(spark, sf):
    emb = T(spark, sf, "embeddings")
    queries = emb.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    chunks = emb.select(F.col("vec_id").alias("cid"), "embedding", F.col("label").alias("content_hash"))
    ids = emb.select("label").distinct()
    hits = L.search(queries, chunks, k=5, ids=ids)
    return hits.select("qid", F.col("rank").cast("bigint").alias("rank"), "cid", "dist")


D7_SQL = f"""
WITH sel AS (SELECT DISTINCT label FROM embeddings),
c AS (SELECT vec_id, embedding, label FROM embeddings WHERE label IN (SELECT label FROM sel)),
pairs AS (SELECT q.vec_id AS qid, c.vec_id AS cid, round({d_sqdist('q.embedding', 'c.embedding')}, 6) AS dist
          FROM embeddings q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS rank FROM pairs)
SELECT qid, rank::BIGINT AS rank, cid, dist FROM r WHERE rank <= 5
"""


def d8_ids_for_titles(spark, sf):
    lib = _library(spark, sf)
    return L.ids_for_titles(_docs(spark, sf).select("title"), lib.select("title", "content_hash"))


D8_SQL = f"""
WITH {_FIRST}
SELECT d.title, lib.content_hash FROM (SELECT {d_title()} AS title FROM documents) d JOIN lib USING (title)
"""


def d9_docu_search(spark, sf):
    """docu_search: benchmark items as queries over the embedded chunk library, k=5, context text."""
    chunks = L.chunk_documents(_library(spark, sf))
    lib = pinned(L.embed(chunks, "chunk_id", "text", keep=("chunk_no", "text", "source", "content_hash")), "library")   # read twice
    qs = L.embed(T(spark, sf, "benchmark"), "item_id", "text").select(F.col("item_id").alias("qid"),
                                                                      F.col("embedding").alias("qvec"))
    # written: the planner sees how few they are, and need not send the library's texts to them
    hits = pinned(L.search(qs, lib.select(F.col("chunk_id").alias("cid"), "embedding", "content_hash"), k=5), "hits")
    hits = hits.join(lib.select(F.col("chunk_id").alias("cid"), "text", "source"), "cid")
    ctx = L.assemble_context(hits)
    return ctx.select("qid", F.length("context").cast("bigint").alias("n_chars"),
                      F.md5("context").alias("context_md5"))


def _d_dense(key: str, dim: int = 384) -> str:
    return f"""cn_{key} AS (SELECT {key}, b, n / norm AS w FROM c_{key} JOIN n_{key} USING ({key})),
v_{key} AS (SELECT k.{key}, list(coalesce(cn.w, 0.0)::FLOAT ORDER BY r.i) AS emb
        FROM keys_{key} k CROSS JOIN range(0, {dim}) r(i)
        LEFT JOIN cn_{key} cn ON cn.{key} = k.{key} AND cn.b = r.i GROUP BY k.{key})"""


D9_SQL = f"""
WITH {_FIRST},
s AS (SELECT content_hash, title, {d_sentences('text')} AS l FROM lib),
p AS (SELECT content_hash, title, {d_pack('l')} AS c FROM s),
e AS (SELECT content_hash, title, c, unnest(generate_series(1, len(c))) AS i FROM p),
chunks AS (SELECT content_hash || '_chunk' || CAST(i AS VARCHAR) AS chunk_id, c[i] AS text, title AS source FROM e),
{_d_embed_counts('chunks', 'chunk_id', 'text')},
keys_chunk_id AS (SELECT chunk_id FROM chunks),
{_d_dense('chunk_id')},
{_d_embed_counts('benchmark', 'item_id', 'text')},
keys_item_id AS (SELECT item_id FROM benchmark),
{_d_dense('item_id')},
pairs AS (SELECT q.item_id AS qid, c.chunk_id AS cid, round({d_sqdist('q.emb', 'c.emb')}, 6) AS dist
          FROM v_item_id q, v_chunk_id c),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid) AS rank FROM pairs),
top AS (SELECT r.qid, r.rank, ch.text, ch.source FROM r JOIN chunks ch ON ch.chunk_id = r.cid WHERE rank <= 5),
ctx AS (SELECT qid, string_agg(text || chr(10) || ' [Source: ' || source || ']' || chr(10), '' ORDER BY rank) AS context
        FROM top GROUP BY qid)
SELECT qid, length(context)::BIGINT AS n_chars, md5(context) AS context_md5 FROM ctx
"""


def d10_list_library(spark, sf):
    return L.list_library(_library(spark, sf))


D10_SQL = f"""
WITH {_FIRST}
SELECT DISTINCT title FROM lib
"""

QUERIES = {
    "D1_sentences": (d1_sentences, D1_SQL),
    "D2_pack_chunks": (d2_pack_chunks, D2_SQL),
    "D3_chunk_rows": (d3_chunk_rows, D3_SQL),
    "D4_ingest_new": (d4_ingest_new, D4_SQL),
    "D5_ingest_status": (d5_ingest_status, D5_SQL),
    "D6_embed": (d6_embed, D6_SQL),
    "D7_search": (d7_search, D7_SQL),
    "D8_ids_for_titles": (d8_ids_for_titles, D8_SQL),
    "D9_docu_search": (d9_docu_search, D9_SQL),
    "D10_list_library": (d10_list_library, D10_SQL),
}
