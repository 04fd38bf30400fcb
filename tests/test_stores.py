"""Keyed stores: null keys, repeats, folders read and written, compaction; the operators over them."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import memory as M
from tessera.operators import results as E
from tessera.plans import chain as G
from tessera.sources.keyed import BUCKET, KeyedStore
from tessera.streaming import streams as S

TURNS = "user_id string, session_id string, ts timestamp, user_prompt string, llm_answer string"


def turns(spark, rows):
    return spark.createDataFrame(rows, "user_id string, session_id string, t int, user_prompt string, llm_answer string").select(
        "user_id", "session_id", F.timestamp_seconds("t").alias("ts"), "user_prompt", "llm_answer")


def files(path):
    return glob.glob(os.path.join(path, "bucket=*", "*.parquet"))


def test_null_keys_match_and_repeats_are_dropped(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "a string, b int, v string", ("a", "b"))
    rows = spark.createDataFrame([("x", 1, "p"), ("x", 1, "o"), (None, 1, "n"), ("x", None, "m"), (None, None, "l"), (None, None, "l"),
                                  ("null", 1, "k"), ("", 1, "j")], "a string, b int, v string")
    assert store.read().count() == 0 and store.compact() == 0
    store.add(rows)
    want = sorted([("x", 1, "o"), (None, 1, "n"), ("x", None, "m"), (None, None, "l"), ("null", 1, "k"), ("", 1, "j")], key=str)
    assert sorted(map(tuple, store.read().collect()), key=str) == want
    store.add(rows.withColumn("v", F.lit("later")))
    assert sorted(map(tuple, store.read().collect()), key=str) == want
    asked = spark.createDataFrame([(None, None), ("x", 1), ("y", 1)], "a string, b int")
    assert sorted(map(tuple, store.matching(asked).collect()), key=str) == sorted([(None, None, "l"), ("x", 1, "o")], key=str)


def test_a_batch_reads_its_own_folders_only(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "k long, v long", ("k",), buckets=64)
    store.add(spark.range(3000).select(F.col("id").alias("k"), F.col("id").alias("v")))
    one = spark.createDataFrame([(5, 0), (3001, 0)], "k long, v long")
    plan = store.new_rows(one)._jdf.queryExecution().toString()
    number = {r[0] for r in spark.read.parquet(store.path).where("k = 5").select(BUCKET).collect()}
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    scanned = store.read(one).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(scanned) <= 2 and any(f"bucket={next(iter(number))}/" in r.f for r in scanned)
    assert [tuple(r)[:2] for r in store.new_rows(one).collect()] == [(3001, 0)]


def test_files_do_not_grow_with_users_and_are_merged(spark, tmp_path):
    path = str(tmp_path / "memory")
    for batch in range(5):
        M.append_turns(turns(spark, [(f"u{i}", f"s{i % 7}", batch, "p", "a") for i in range(400)]), path)
    assert len(glob.glob(os.path.join(path, "*="))) == 0 and len(glob.glob(os.path.join(path, "bucket=*"))) <= 256
    before = sorted(map(tuple, M.read_memory(spark, path).collect()))
    assert len(before) == 2000
    store = M.memory_store(spark, path)
    many = len(files(path))
    assert store.compact(files=2) > 0 and len(files(path)) < many
    assert sorted(map(tuple, M.read_memory(spark, path).collect())) == before
    M.append_turns(turns(spark, [("u1", "s1", 4, "p", "a"), ("u1", "s1", 9, "p", "a")]), path)
    assert M.read_memory(spark, path).count() == 2001


def test_a_hot_folder_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store = KeyedStore(spark, str(tmp_path / "s"), "s string, k long, v string", ("s", "k"), ("s",))
        store.add(spark.range(20000).select(F.lit("hot").alias("s"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v")))
        assert len(files(store.path)) > 1 and store.read().count() == 20000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_appended_turns_with_null_keys_and_answers(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = turns(spark, [(None, "s", 1, "p", "a"), (None, "s", 1, "p", "a"), ("u", None, 2, "p", None), ("u", "s", 3, None, "a"), ("u", "s", 4, "q", "b")])
    for _ in range(2):
        M.append_turns(rows, path)
    got = M.read_memory(spark, path)
    assert got.count() == 4 and got.where("user_prompt is null or llm_answer is null").count() == 0
    assert M.read_memory(spark, path, spark.createDataFrame([(None, "s")], "user_id string, session_id string")).count() == 1
    history = {(r.user_id, r.session_id): r.history for r in M.session_history(rows.distinct()).collect()}
    assert history == {(None, "s"): "p a ", ("u", None): "p  ", ("u", "s"): " a q b "}


def test_memorized_results_with_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([("u", None, "n", "first", 1), ("u", None, "n", "second", 2), (None, None, None, "t", 1), ("u", "s", "n", "x", 1)],
                                 "user_id string, session_id string, stored_result_name string, text string, ts int")
    store = E.store_after(rows, None)
    again = E.store_after(rows.withColumn("text", F.lit("later")), store)
    assert sorted(r.text for r in again.collect()) == ["first", "t", "x"]
    got = E.recall_results(rows.select(*E.RESULT_KEY).distinct(), again)
    assert sorted(r.text for r in got.collect()) == ["first", "t", "x"]
    path = str(tmp_path / "r")
    for text in ("now", "later"):
        E.memorize_into(rows.withColumn("text", F.lit(text)), path)
    asked = rows.select(*E.RESULT_KEY).distinct().unionByName(spark.createDataFrame([("no", "s", "n")], ", ".join(f"{c} string" for c in E.RESULT_KEY)))
    assert sorted(str(r.text) for r in E.recall_from(asked, path).collect()) == ["None", "now", "now", "now"]


def test_chain_recalls_from_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "r")
    prompts = spark.createDataFrame([(1, "u", "s", "one"), (2, "u", None, "two"), (3, "v", "s", "three")],
                                    "row_id int, user_id string, session_id string, prompt string")
    ctx = G.ChainContext(spark, user_tag="", assistant_tag="")
    G.run_chain(prompts, [("{full_prompt}", "MemorizeResult", "{'stored_result_name': 'a'}", "")], ctx)
    G.commit_results(ctx, path)
    ctx.result_store = E.result_store(spark, path)
    out = G.run_chain(prompts.withColumn("prompt", F.lit("later")), [("", "getMemoryResult", "{'stored_result_name': 'a'}", "")], ctx)
    assert {r.row_id: r.result for r in out.collect()} == {1: "one", 2: "two", 3: "three"}


def test_streamed_turns_repeated_in_one_batch(spark, tmp_path):
    rows = [(1, 0, "user", "p"), (1, 0, "user", "p"), (1, 1, "assistant", "a"), (None, 0, "user", "q")]
    spark.createDataFrame(rows, S.TURN_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    memory = str(tmp_path / "memory")
    for run in ("one", "two"):
        S.stream_turns(spark, str(tmp_path / "in"), memory, checkpoint=str(tmp_path / f"ckpt-{run}"))
    assert S.raw_turns(spark, memory).read().count() == 3


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_keys_do_not_depend_on_the_session_time_zone(spark, tmp_path_factory, zone):
    path = str(tmp_path_factory.getbasetemp() / "zones")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        M.append_turns(turns(spark, [("u", "s", 1_700_000_000, "p", "a")]), path)
        assert M.read_memory(spark, path).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
