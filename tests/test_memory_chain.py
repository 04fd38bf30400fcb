import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import complete as K
from tessera.operators import memory as M
from tessera.plans import chain as G
from tessera.plans.presets import DEFAULT_SEQ

T0 = dt.datetime(2024, 1, 1)


def turns(spark, rows):
    return spark.createDataFrame(
        [("u", s, T0 + dt.timedelta(minutes=m), p, a) for s, m, p, a in rows],
        "user_id string, session_id string, ts timestamp, user_prompt string, llm_answer string")


def test_sliding_memory_keeps_longest_fitting_suffix(spark):
    t = turns(spark, [("s", 0, "a" * 10, "b" * 10), ("s", 1, "c" * 5, "d" * 5), ("s", 2, "e" * 3, "f" * 3)])
    kept = M.sliding_memory(t, max_tok=(8 + 12) / 3.5).orderBy("ts").collect()
    assert [r.suffix_chars for r in kept] == [20, 8]
    assert M.sliding_memory(t, max_tok=1).count() == 0                  # history that fits nothing


def test_prompt_with_history_spacing(spark):
    t = turns(spark, [("s", 0, "p1", "a1"), ("s", 1, "p2", "a2")])
    got = [r.full_prompt for r in M.prompt_with_history(t, "<u>", "<a>").orderBy("ts").collect()]
    assert got == [" <u>p1<a>", "p1 a1  <u>p2<a>"]


def test_drop_last_turn_and_one_turn_session(spark):
    t = turns(spark, [("s", 0, "p1", "a1"), ("s", 1, "p2", "a2"), ("one", 0, "x", "y")])
    left = M.drop_last_turn(t, t.select("user_id", "session_id").filter(F.col("session_id") == "s"))
    assert sorted((r.session_id, r.user_prompt) for r in left.collect()) == [("one", "x"), ("s", "p1")]
    assert M.drop_last_turn(t, t.select("user_id", "session_id")).filter("session_id = 'one'").count() == 0


def test_parse_turns_skips_invalid(spark):
    df = spark.createDataFrame([('{"user_prompt": "hi"}',), ("not json",)], "document string")
    rows = M.parse_turns(df).collect()
    assert len(rows) == 1 and rows[0].user_prompt == "hi" and rows[0].llm_answer == ""


def prompts(spark, texts):
    return spark.createDataFrame([(i, "u", "s", T0, t) for i, t in enumerate(texts)],
                                 "row_id long, user_id string, session_id string, ts timestamp, prompt string")


def test_chain_edge_steps(spark):
    ctx = G.ChainContext(spark, completer_factory=lambda: (lambda ps: [p.upper() for p in ps]),
                         user_tag="", assistant_tag="")
    steps = [("{result}|{full_prompt}", "user_input", "", "next"),       # {result} in step 1 is None
             ("x", "no_such_action", "", "next"),                         # unknown action: skipped
             ("{result}", "llm_completion", "  ", "next")]                # blank option
    out = G.run_chain(prompts(spark, ["say {result}"]), steps, ctx).first()
    assert out.result == "NONE|SAY {RESULT}"


def test_chain_gate(spark):
    ctx = G.ChainContext(spark, completer_factory=lambda: (lambda ps: ["answer " + str(len(p)) for p in ps]),
                         context_size=200, max_length=100)
    out = G.run_chain(prompts(spark, ["short", "x" * 1000]), DEFAULT_SEQ, ctx).orderBy("row_id").collect()
    assert out[1].result == K.TOO_LONG_MSG
    assert out[0].result == "answer " + str(len("[User]: short[Assistant]: "))


def test_route_cycle():
    cat = {"a": G.compile_chain([("x", "user_input", "", "b")]),
           "b": G.compile_chain([("x", "user_input", "", "next"), ("y", "bogus", "", "a")])}
    walk, mu = G.route(cat, "a")
    assert walk == ["a", "b"] and mu == 1          # b stays on b: its last executed step says "next"


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pairs_join_equals_window(spark):
    from tests.conftest import SF

    rows = M.conversation_turns(spark.read.parquet(f"{SF}/conversations.parquet"))
    by_join = M.chat_pairs(rows, seq="turn")
    by_window = M.chat_pairs(rows, seq=None)
    assert by_join.count() == by_window.count()
    assert by_join.exceptAll(by_window).count() == 0


def test_complete_with_format(spark):
    from tessera.functions.guided import named_regex

    df = spark.createDataFrame([('{"df": "SELECT 1"}',), ("free text",)], "p string")
    col = K.complete("p", lambda: (lambda ps: ps), fmt_regex=named_regex("singleexpression"))
    got = [r[0] for r in df.select(col).collect()]
    assert got == ['{"df": "SELECT 1"}', K.FORMAT_ERROR]


def test_ask_refuses_commands(spark):
    from tessera.operators import ask as A

    spark.range(3).createOrReplaceTempView("t3")
    for bad in ("DROP VIEW t3", "SELECT 1; DROP VIEW t3", "INSERT INTO t3 VALUES (1)", "CREATE TABLE x AS SELECT 1"):
        df, msg = A.ask(spark, bad)
        assert df is None and msg == A.FAILED_MSG
    assert spark.table("t3").count() == 3
    df, _ = A.ask(spark, '{"df": "WITH a AS (SELECT * FROM t3) SELECT count(*) AS n FROM a"}')
    assert df.first().n == 3


def test_compile_steps_native(spark):
    steps = spark.createDataFrame([(0, " {full_prompt} ", " llm_completion ", "{'max_length': 486, 'temperature': 0.1}",
                                    "next"), (1, "x", "bogus", "", "a.csv")],
                                  "step_no int, input string, action string, option string, next_df string")
    rows = G.compile_steps(steps).orderBy("step_no").collect()
    assert rows[0].input == "{full_prompt}" and rows[0].known and rows[0].options == {"max_length": "486",
                                                                                         "temperature": "0.1"}
    assert not rows[1].known and rows[1].options == {}


def test_chain_search_actions(spark):
    from tessera.operators import library as L

    pages = spark.createDataFrame([(1, "http://a.example/x", "<title>Alpha</title><article>red apple pie</article>"),
                                   (2, "http://b.example/y", "<title>Beta</title><article>blue sky</article>")],
                                  "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "Red apples. Blue skies.", "src")], "doc_id long, text string, source string")
    chunks = L.chunk_documents(L.ingest_documents(L.with_title(docs), None), max_chars=12)
    lib = chunks.join(L.embed(chunks, "chunk_id", "text"), "chunk_id")
    ctx = G.ChainContext(spark, user_tag="", assistant_tag="", pages=pages, library=lib)
    out = G.run_chain(prompts(spark, ["apple"]), [("{full_prompt}", "internet_search", "", "next")], ctx).first()
    assert out.result.startswith("Note1: Alpha\nred apple pie\nhttp://a.example/x\n")
    out = G.run_chain(prompts(spark, ["red apples"]), [("{full_prompt}", "docu_search", "{'k': 1}", "next")],
                      ctx).first()
    assert out.result == "Red apples. \n [Source: src/1.txt]\n"


def test_ask_candidates_and_catalog(spark):
    import os

    from tessera.operators import ask as A
    from tessera.session import scratch_path
    from tessera.sources import tables as S

    spark.range(4).createOrReplaceTempView("t4")
    df, stmt = A.ask(spark, ["SELECT nope FROM t4", "SELECT count(*) AS n FROM t4"])
    assert df.first().n == 4 and stmt.startswith("SELECT count")
    d = scratch_path(spark, "seqs").replace("file:", "")
    os.makedirs(d)
    with open(os.path.join(d, "ask.csv"), "w") as f:
        f.write("input|action|option|next_df\n{full_prompt}|user_input||tables/echo.csv\n")
    with open(os.path.join(d, "echo.csv"), "w") as f:
        f.write("input|action|option|next_df\nEcho {full_prompt}|user_input||next\n")
    cat = G.catalog_from_sequences(S.read_sequences(spark, d))
    assert G.route(cat, "ask.csv") == (["ask.csv", "echo.csv"], 1)


def test_ids_for_titles_nearest(spark):
    from tessera.operators import library as L

    lib = spark.createDataFrame([("src/report_alpha.txt", "h1"), ("src/notes_beta.txt", "h2")],
                                "title string, content_hash string")
    sel = spark.createDataFrame([("report alpha",), ("src/notes_beta.txt",)], "title string")
    got = {r.title: r.content_hash for r in L.ids_for_titles(sel, lib, nearest=True).collect()}
    assert got == {"report alpha": "h1", "src/notes_beta.txt": "h2"}
    assert L.ids_for_titles(sel, lib).count() == 1


def test_chain_with_history(spark):
    rows = [(0, "u", "s", T0, "p1"), (1, "u", "s", T0 + dt.timedelta(minutes=1), "p2")]
    df = spark.createDataFrame(rows, "row_id long, user_id string, session_id string, ts timestamp, prompt string")
    ctx = G.ChainContext(spark, user_tag="<u>", assistant_tag="<a>")
    out = G.run_chain(df, [("{full_prompt}", "user_input", "", "next")], ctx, include_history=True)
    got = [r.result for r in out.orderBy("row_id").collect()]
    assert got == [" <u>p1<a>", "p1  " + " <u>p2<a>"]


def test_prompt_with_history_budget(spark):
    import random

    rnd = random.Random(7)
    rows = [("s", m, "p" * rnd.randint(0, 9), "a" * rnd.randint(0, 9)) for m in range(12)]
    t = turns(spark, rows)
    budget = 25
    got = {r.ts: r.full_prompt for r in M.prompt_with_history(t, "<u>", "<a>", max_chars=budget).collect()}
    for i, (_, m, p, a) in enumerate(rows):
        keep, total = [], 0
        for _, _, pj, aj in reversed(rows[:i]):             # latest earlier turns first
            piece = pj + " " + aj + " "
            if total + len(piece) > budget:
                break
            total += len(piece)
            keep.insert(0, piece)
        want = "".join(keep).lstrip(" \t\r\n\f\x0b") + " <u>" + p + "<a>"
        assert got[T0 + dt.timedelta(minutes=m)] == want
    full = {r.ts: r.full_prompt for r in M.prompt_with_history(t, "<u>", "<a>").collect()}
    assert len(full[T0 + dt.timedelta(minutes=11)]) >= len(got[T0 + dt.timedelta(minutes=11)])


def test_chain_with_history_budget(spark):
    rows = [(i, "u", "s", T0 + dt.timedelta(minutes=i), f"p{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "row_id long, user_id string, session_id string, ts timestamp, prompt string")
    ctx = G.ChainContext(spark, user_tag="<u>", assistant_tag="<a>")
    out = G.run_chain(df, [("{full_prompt}", "user_input", "", "next")], ctx, include_history=True,
                      history_chars=8)
    got = [r.result for r in out.orderBy("row_id").collect()]
    assert got[3] == "p1  p2   <u>p3<a>"      # each earlier piece "pN  " costs 4 characters


def test_archive_with_model_summary(spark):
    t = turns(spark, [("s", 0, "p1", "a1"), ("s", 1, "p2", "a2")])
    summ = M.model_summarizer(lambda: (lambda ps: [p.split(": ", 1)[1][:5] for p in ps]))
    row = M.archive_sessions(t, summ).first()
    assert row.summary == "p1 a1"
    assert M.archive_sessions(t).first().summary == M.SUMMARY_PLACEHOLDER


def test_presets_route_by_key():
    from tessera.plans.presets import PRESETS

    cat = {k: G.compile_chain(v) for k, v in PRESETS.items()}
    assert G.route(cat, "csv_peek") == (["csv_peek", "default"], 1)
    assert G.route(cat, "ask_sql") == (["ask_sql"], 0)


def test_table_question_chain(spark):
    from tessera.plans.presets import ASK_SQL
    from tests.conftest import SF

    spark.read.parquet(f"{SF}/customer.parquet").createOrReplaceTempView("df")
    answer = '{"df": "SELECT c_mktsegment, count(*) AS n FROM df GROUP BY c_mktsegment"}'
    ctx = G.ChainContext(spark, completer_factory=lambda: (lambda ps: [answer for _ in ps]),
                         user_tag="", assistant_tag="", max_length=200)
    out = G.run_chain(prompts(spark, ["customers per segment?"]), ASK_SQL, ctx, log=True)
    row = out.first()
    assert "Number of Records: 5" in row.result
    steps = [(r.action, r.result) for r in G.step_log(out).orderBy("step_no").collect()]
    assert steps[0][1].startswith("The uploaded table contains : 150 records.")
    assert steps[1] == ("llm_completion", answer)
    assert [a for a, _ in steps] == ["csv_peek", "llm_completion", "execute_df_expression", "user_input"]


def test_each_prompt_of_a_session_has_the_turns_that_fit_beside_it(spark):
    memory = turns(spark, [("s", m, f"q{m}" + "x" * 8, f"a{m}" + "y" * 8) for m in range(4)] + [("t", 0, "other", "turn")])
    pieces = [f"q{m}xxxxxxxx a{m}yyyyyyyy " for m in range(4)]
    asked = [(1, "s", "p" * 4), (2, "s", "p" * 30), (3, "s", "p" * 60), (4, "s", "p" * 500), (5, "t", "p"), (6, "new", "p"), (7, "s", "p" * 4)]
    df = spark.createDataFrame([(i, "u", s, T0 + dt.timedelta(hours=i), p) for i, s, p in asked],
                               "row_id bigint, user_id string, session_id string, ts timestamp, prompt string")
    ctx = G.ChainContext(spark, context_size=28, max_length=0, user_tag="", assistant_tag="")        # 98 characters
    out = G.run_chain(df, [("{full_prompt}", "user_input", "", "next")], ctx, memory=memory)
    got = {r["row_id"]: r["full_prompt"] for r in out.collect()}
    assert got == {1: "".join(pieces) + "p" * 4, 2: "".join(pieces[1:]) + "p" * 30, 3: pieces[3] + "p" * 60, 4: "p" * 500,
                   5: "other turn p", 6: "p", 7: "".join(pieces) + "p" * 4}


def test_words_inside_quoted_options_stay(spark):
    options = ["{'title': 'True North', 'on': True, 'off': False, 'none': None}", "{\"a\": \"None 'x' True\", 'b': 'it\\'s \"so\"'}",
               "{'k': 'a, b: False'}", "{'n': 1, 'x': 0.5}", "", "{'open: 1}"]
    steps = spark.createDataFrame([(i, "x", "user_input", o, "next") for i, o in enumerate(options)],
                                  "step_no int, input string, action string, option string, next_df string")
    got = {r.step_no: r.options for r in G.compile_steps(steps).collect()}
    for i, o in enumerate(options[:5]):
        want = {k: {True: "true", False: "false"}.get(v, v) if isinstance(v, bool) else v for k, v in G.parse_option(o).items()}
        assert got[i] == {k: None if v is None else str(v) for k, v in want.items()}, o
    assert got[5] is None
