from pyspark.sql import functions as F

from tessera.functions.text import sentences
from tessera.operators import library as L
from tests.conftest import SF


def pack(spark, text, n=20):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(L.pack_chunks(sentences("t"), n)).first()[0]


def test_pack_rules(spark):
    assert pack(spark, "Aa. Bb. Cc.", 8) == ["Aa. Bb. ", "Cc. "]
    # a first sentence over the limit emits an empty first chunk and stays whole
    assert pack(spark, "A very long sentence. B.", 8) == ["", "A very long sentence. ", "B. "]
    # last sentence equal to an earlier one: emitted once at the end
    assert pack(spark, "X. Y. X.", 100) == ["X. Y. X. "]
    assert pack(spark, "", 8) == []


def test_chunks_cover_sentences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = docs.select(sentences("text").alias("s"), L.pack_chunks(sentences("text")).alias("c"))
    bad = packed.filter(F.array_join("s", " ") != F.trim(F.array_join("c", ""))).count()
    assert bad == 0


def test_ingest_twice_is_ingest_once(spark):
    docs = L.with_title(spark.read.parquet(f"{SF}/documents.parquet"))
    first = L.ingest_documents(docs, None)
    again = L.ingest_documents(docs, first.select("content_hash"))
    assert again.count() == 0
    assert first.count() == docs.select(F.md5("text")).distinct().count()


def test_search_ties_and_empty_selection(spark):
    chunks = spark.createDataFrame(
        [(1, [1.0, 0.0], "h1"), (2, [0.0, 1.0], "h1"), (3, [-1.0, 0.0], "h2"), (4, [0.0, -1.0], "h2")],
        "cid long, embedding array<float>, content_hash string")
    qs = spark.createDataFrame([(10, [0.0, 0.0])], "qid long, qvec array<float>")
    hits = L.search(qs, chunks, k=2).orderBy("rank").collect()
    assert [(h.cid, h.dist) for h in hits] == [(1, 1.0), (2, 1.0)]       # equal distance: lower id first
    only_h2 = L.search(qs, chunks, k=5, ids=spark.createDataFrame([("h2",)], "h string")).collect()
    assert sorted(h.cid for h in only_h2) == [3, 4]
    none = L.search(qs, chunks, k=5, ids=spark.createDataFrame([], "h string")).collect()
    assert none == []


def test_search_exact_against_brute_force(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    qs = emb.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    ch = emb.select(F.col("vec_id").alias("cid"), "embedding", F.col("label").alias("content_hash"))
    got = {(r.qid, r.rank): r.cid for r in L.search(qs, ch, k=3, n_cells=8, query_block=3).collect()}
    rows = emb.collect()
    import numpy as np
    V = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    for i in range(len(rows)):
        d = np.round(((V - V[i]) ** 2).sum(axis=1), 6)
        want = ids[np.lexsort((ids, d))[:3]]
        assert [got[(ids[i], r)] for r in (1, 2, 3)] == list(want)


def test_assemble_context(spark):
    hits = spark.createDataFrame([(1, 2, "b", "s2"), (1, 1, "a", "s1")], "qid long, rank int, text string, source string")
    assert L.assemble_context(hits).first()["context"] == "a\n [Source: s1]\nb\n [Source: s2]\n"


def test_plugged_encoder(spark):
    import numpy as np

    def encoder(texts):
        return [np.array([len(t), 1.0], dtype=np.float32) for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "abcd")], "id long, t string")
    got = {r.id: list(r.embedding) for r in L.embed(df, "id", "t", encoder=encoder).collect()}
    assert got == {1: [2.0, 1.0], 2: [4.0, 1.0]}


def test_search_prunes_far_cells(spark):
    # two far clusters: a query near one never probes the other, so some blocks are empty
    rows = [(i, [float(i % 3), 0.0], "a") for i in range(20)] + [(100 + i, [1000.0 + i % 3, 0.0], "b")
                                                                 for i in range(20)]
    chunks = spark.createDataFrame(rows, "cid long, embedding array<float>, content_hash string")
    qs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1001.0, 0.0])], "qid long, qvec array<float>")
    hits = L.search(qs, chunks, k=2, n_cells=2).orderBy("qid", "rank").collect()
    assert [(h.qid, h.cid) for h in hits] == [(1, 0), (1, 3), (2, 101), (2, 104)]


def test_plugged_encoder_factory(spark):
    import numpy as np

    def factory():
        return lambda texts: [np.array([float(len(t))], dtype=np.float32) for t in texts]

    df = spark.createDataFrame([(1, "abc")], "id long, t string")
    assert L.embed(df, "id", "t", encoder_factory=factory).first().embedding == [3.0]


def test_embed_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, "word"), (2, ""), (3, None), (4, "!!")], "id long, t string")
    got = {r.id: r.embedding for r in L.embed(df, "id", "t", dim=4).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[2] == got[3] == got[4] == [0.0] * 4 and abs(sum(x * x for x in got[1]) - 1) < 1e-6


def test_search_with_id_list(spark):
    chunks = spark.createDataFrame([(1, [0.0, 1.0], "h1"), (2, [0.0, 2.0], "h2")],
                                   "cid long, embedding array<float>, content_hash string")
    qs = spark.createDataFrame([(10, [0.0, 0.0])], "qid long, qvec array<float>")
    assert [h.cid for h in L.search(qs, chunks, k=5, ids=["h2"]).collect()] == [2]
    assert L.search(qs, chunks, k=5, ids=[]).collect() == []


def plain_pack(parts, n):
    out, cur = [], ""
    for s in parts:
        if len(cur) + len(s) > n:
            out.append(cur)
            cur = ""
        cur += s + " "
    return out + ([cur] if cur else [])


def test_packing_equals_a_plain_loop(spark):
    import random

    r = random.Random(2)
    rows = [([r.choice(["a", "bb.", "ccc ccc.", "d" * 30, "é中."]) for _ in range(r.randint(0, 40))],) for _ in range(200)] + [(None,)]
    df = spark.createDataFrame(rows, "s array<string>")
    for n in (8, 25, 1024):
        got = df.select("s", L.pack_chunks("s", n).alias("c")).collect()
        assert all(x.c == (None if x.s is None else plain_pack(x.s, n)) for x in got)


IDS = [(None, "same"), (None, "same"), (None, "some"), (4, "some"), (2, "some"), (2, "some"), (7, None), (None, None), (8, ""), (9, "alone")]


def test_documents_without_ids_or_texts_are_ingested(spark):
    docs = spark.createDataFrame([(i, t, "title") for i, t in IDS], "doc_id long, text string, title string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in L.ingest_documents(docs, None).collect()), key=str)
    assert got == sorted([(None, "same"), (2, "some"), (7, None), (8, ""), (9, "alone")], key=str)
    held = docs.where("text in ('same', 'alone')").select(F.md5("text").alias("content_hash"))
    assert sorted(((r.doc_id, r.text) for r in L.ingest_documents(docs, held).collect()), key=str) == sorted([(2, "some"), (7, None), (8, "")], key=str)


def test_every_document_has_a_status_and_one_of_each_text_is_added(spark):
    docs = spark.createDataFrame([(i, t, "title") for i, t in IDS], "doc_id long, text string, title string").repartition(3)
    for held in (None, docs.limit(0).select(F.md5("text").alias("content_hash"))):
        got = L.ingest_status(docs, held).collect()
        assert len(got) == len(IDS) and all(r.message for r in got)
        added = sorted((str(r.doc_id), str(r.content_hash)) for r in got if r.status == "added")
        want = sorted((str(r.doc_id), str(r.content_hash)) for r in L.ingest_documents(docs, None).collect())
        assert added == want
    known = L.ingest_status(docs, docs.where("text = 'some'").select(F.md5("text").alias("content_hash")))
    assert known.where("status = 'added'").count() == 4


def test_one_pass_meets_only_the_rings_in_reach(spark):
    import numpy as np

    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8)) * 50
    V = np.concatenate([c + r.normal(size=(700, 8)) for c in centres]).astype(np.float32)
    Q = np.concatenate([c + r.normal(size=(30, 8)) for c in centres[:2]]).astype(np.float32)
    chunks = spark.createDataFrame([(f"c{i:05d}", v.tolist(), "h") for i, v in enumerate(V)], "cid string, embedding array<float>, content_hash string")
    queries = spark.createDataFrame([(i % 50, q.tolist()) for i, q in enumerate(Q)], "qid int, qvec array<float>")   # some ids twice
    index = L.build_index(chunks, n_cells=6)
    assert index.rings.select("block").distinct().count() >= 5 and index.data.groupBy("block").count().agg(F.max("count")).head()[0] <= L.BLOCK_ROWS
    got = L.search_index(queries, index, k=4, query_block=7).collect()
    want = []
    for i, q in enumerate(Q):
        d = np.round(((V.astype(float) - q.astype(float)) ** 2).sum(1), 6)
        want += [(i % 50, rank + 1, f"c{j:05d}") for rank, j in enumerate(np.lexsort((np.arange(len(V)), d))[:4])]
    assert sorted((h.qid, h.rank, h.cid) for h in got) == sorted(want)
    few = L.search(queries, chunks.limit(2), k=5)
    assert few.groupBy("rank").count().orderBy("rank").collect()[0]["count"] == len(Q) and few.agg(F.max("rank")).head()[0] == 2


def test_a_query_is_sent_to_a_region_once(spark, monkeypatch):
    import numpy as np

    written, pinned = {}, L.pinned
    monkeypatch.setattr(L, "BLOCK_ROWS", 32)
    monkeypatch.setattr(L, "pinned", lambda df, name: written.setdefault(name, pinned(df, name)))
    r = np.random.default_rng(7)
    V = np.concatenate([np.zeros((300, 8)), r.normal(size=(1200, 8))]).astype(np.float32)      # many rows at one place
    Q = np.concatenate([np.zeros((3, 8)), r.normal(size=(37, 8))])
    chunks = spark.createDataFrame([(i, v.tolist(), "h") for i, v in enumerate(V)], "cid long, embedding array<float>, content_hash string")
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(Q)], "qid int, qvec array<double>")
    got = sorted((h.qid, h.rank, h.cid, h.dist) for h in L.search(queries, chunks, k=4, query_block=11).collect())
    want = []
    for i, q in enumerate(Q):
        d = np.round(((V.astype(float) - q) ** 2).sum(1), 6)
        want += [(i, rank + 1, int(j)) for rank, j in enumerate(np.lexsort((np.arange(len(V)), d))[:4])]
    assert [h[:3] for h in got] == want
    # about 47 blocks in 16 regions
    assert 0 < written["meetings"].count() <= len(Q) * (L.REGIONS + 4)


def test_placing_works_on_small_slices(spark):
    import numpy as np
    import pyarrow as pa

    batch = pa.record_batch({"cid": pa.array(range(5000)), "v": pa.array(np.ones((5000, 2), np.float32).tolist(), pa.list_(pa.float32()))})
    parts = list(L._slices(batch))
    assert sum(p.num_rows for p in parts) == 5000 and max(p.num_rows for p in parts) <= L.BLOCK_ROWS
    assert L._matrix(parts[-1].column(1)).shape == (5000 % L.BLOCK_ROWS, 2)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_every_text_is_packed_once(spark):
    rows = [(1, "One. Two! Three?", "t"), (2, "", "t"), (3, None, "t"), (4, "  ", "t"), (5, "x " * 600 + ". End.", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string")
    chunks = L.chunk_documents(docs, keep=("doc_id",))
    # no filter inferred from the generator that splits and packs again, and one fold
    assert optimized(chunks).count("aggregate(") == 1
    want = [(1, 1, "One. Two! Three? "), (5, 1, ""), (5, 2, "x " * 600 + ". "), (5, 3, "End. ")]
    assert sorted((c.doc_id, c.chunk_no, c.text) for c in chunks.collect()) == want


def test_ingest_sends_texts_to_other_tasks_once(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}", "t") for i in range(50)], "doc_id long, text string, title string").repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = L.ingest_documents(docs, None)
        plan = optimized(new)
        assert "Join" not in plan and plan.count("Window [") == 1
        assert sorted((r.doc_id, r.text) for r in new.collect()) == [(i, f"text {i}") for i in range(7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_embedding_keeps_columns_and_hashes_as_token_bucket(spark):
    texts = ["Wörter und wörter", "а б в Ä ß", "x1 y2 x1", "", None, "中文 字 İ", "!!", "end of it"]
    df = spark.createDataFrame([(i, t, i * 10) for i, t in enumerate(texts)], "id int, t string, more int").coalesce(1)
    got = {r.id: (r.more, list(r.embedding)) for r in L.embed(df, "id", "t", dim=50, keep=("more",)).collect()}
    buckets = df.select("id", F.transform(L.hash_tokens("t"), lambda x: L.token_bucket(x, 50)).alias("b")).collect()
    for r in buckets:
        counts = [(r.b or []).count(i) for i in range(50)]
        norm = sum(c * c for c in counts) ** 0.5 or 1
        assert got[r.id][0] == r.id * 10 and all(abs(x - c / norm) < 1e-6 for x, c in zip(got[r.id][1], counts))


def test_few_queries_meet_the_rows_where_they_lie(spark, monkeypatch):
    import numpy as np

    written, pinned = [], L.pinned
    monkeypatch.setattr(L, "pinned", lambda df, name: written.append(name) or pinned(df, name))
    r = np.random.default_rng(11)
    V = np.concatenate([np.zeros((40, 6)), r.normal(size=(2500, 6)), np.ones((40, 6))]).astype(np.float32)      # copies tie by id
    V[100] = np.nan
    Q = np.concatenate([np.zeros((2, 6)), np.ones((1, 6)), r.normal(size=(9, 6))])
    ids = [f"c{i:05d}" for i in r.permutation(len(V))]
    chunks = spark.createDataFrame([(c, v.tolist(), "h" if i % 5 else "other") for i, (c, v) in enumerate(zip(ids, V))],
                                   "hit string, embedding array<float>, content_hash string").repartition(5)
    queries = spark.createDataFrame([(i % 10, q.tolist()) for i, q in enumerate(Q)], "ask int, v array<double>")   # some ids twice
    for chosen in (None, ["h"]):
        got = L.search(queries, chunks, k=4, ids=chosen, qkey="ask", qvec="v", ckey="hit").collect()
        want = []
        for i, q in enumerate(Q):
            d = np.round(((V.astype(float) - q) ** 2).sum(1), 6)
            found = sorted((x, c) for j, (x, c) in enumerate(zip(d, ids)) if np.isfinite(x) and (not chosen or j % 5))[:4]
            want += [(i % 10, rank + 1, c, x) for rank, (x, c) in enumerate(found)]
        assert sorted((h.ask, h.rank, h.hit) for h in got) == sorted(w[:3] for w in want)
        assert np.allclose(sorted(h.dist for h in got), sorted(w[3] for w in want), atol=2e-6)
    # no chunk is placed, written or sent on
    assert "queries" in written and not {"rings", "meetings"} & set(written)
    assert L.search(queries.limit(0), chunks, qkey="ask", qvec="v", ckey="hit").collect() == []
    assert L.search(queries, chunks.limit(0), qkey="ask", qvec="v", ckey="hit").collect() == []
