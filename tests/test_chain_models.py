"""Models in chains: called once per row and step, with the step's options; stores, statements and their refusal."""

import os

import pytest

from tessera.operators import ask as A
from tessera.operators import results as E
from tessera.plans import chain as G


@pytest.fixture
def prompts(spark):
    rows = [(i, f"u{i % 3}", f"s{i}", i, f"prompt number {i}" if i % 10 else "long " * 5000) for i in range(40)]
    return spark.createDataFrame(rows, "row_id int, user_id string, session_id string, ts int, prompt string").repartition(4).cache()


def writing_model(folder):
    """Answers with a new text at every call and notes every prompt and its options."""
    def factory():
        import uuid

        def model(texts, **options):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("".join(f"{sorted(options.items())}\n" for _ in texts))
            return [f"{uuid.uuid4().hex} [User]: more" for _ in texts]
        return model
    return factory


def calls(folder):
    return [line for name in os.listdir(folder) for line in open(os.path.join(folder, name))]


PAGES = "page_id long, url string, html string"


def test_model_runs_once_before_every_kind_of_action(spark, prompts, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>prompt</p>"), (2, "http://b.example/", "<p>number</p>")], PAGES)
    steps = [("{full_prompt}", "llm_completion", "{'max_length': 9, 'temperature': 0.5, 'top_p': 0.9}", "next"),
             ("{result}", "MemorizeResult", "{'stored_result_name': 'a'}", "next"),
             ("{result}", "getwebpage", "{}", "next"), ("{full_prompt}", "internet_search", "", "next"),
             ("{full_prompt} {result}", "llm_completion", "{'temperature': 0.1}", "next"),
             ("{result}", "MemorizeResult", "{'stored_result_name': 'b'}", "next"),
             ("", "getMemoryResult", "{'stored_result_name': 'a'}", "next")]
    ctx = G.ChainContext(spark, completer_factory=writing_model(str(tmp_path)), pages=pages)
    out = G.run_chain(prompts, steps, ctx, log=True)
    rows = out.collect()
    made = calls(tmp_path)
    fits = sum(r["row_id"] % 10 != 0 for r in rows)
    assert len(made) == 2 * fits
    assert sum("('max_length', 9), ('temperature', 0.5), ('top_p', 0.9)" in m for m in made) == fits
    store = str(tmp_path / "store")
    logged = {r["row_id"]: {(s["step_no"]): s["result"] for s in r["log"]} for r in rows}
    recalled = {r["session_id"]: r["result"] for r in rows if r["row_id"] % 10}
    G.commit_results(ctx, store)
    assert len(calls(tmp_path) if not os.path.isdir(store) else made) == 2 * fits
    kept = {(r["session_id"], r["stored_result_name"]): r["text"] for r in spark.read.parquet(store).collect()}
    assert len(kept) == 2 * fits                          # prompts over the budget store nothing
    for r in rows:
        if r["row_id"] % 10:
            assert kept[r["session_id"], "a"] == logged[r["row_id"]][0] == recalled[r["session_id"]]
            assert kept[r["session_id"], "b"] == logged[r["row_id"]][4]


def test_words_are_not_cut_after_the_model(spark, prompts):
    ctx = G.ChainContext(spark, completer_factory=lambda: lambda texts: ["a b c d e f"] * len(texts))
    out = G.run_chain(prompts, [("{full_prompt}", "llm_completion", "{'max_length': 2}", "next")], ctx)
    assert {r["result"] for r in out.where("row_id % 10 <> 0").collect()} == {"a b c d e f"}


def test_a_stored_result_comes_before_a_memorized_one(spark, prompts):
    held = spark.createDataFrame([("u1_s1_a", "u1", "s1", "a", "old")], "id string, user_id string, session_id string, stored_result_name string, text string")
    steps = [("new", "MemorizeResult", "{'stored_result_name': 'a'}", ""), ("newer", "MemorizeResult", "{'stored_result_name': 'a'}", ""),
             ("", "getMemoryResult", "{'stored_result_name': 'a'}", "")]
    out = G.run_chain(prompts, steps, G.ChainContext(spark, result_store=held))
    got = {r["session_id"]: r["result"] for r in out.where("row_id % 10 <> 0").collect()}
    assert got["s1"] == "old" and got["s2"] == "new"


def test_actions_with_several_uses_are_refused_on_streams(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "row_id int, prompt string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id int, prompt string").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        G.run_chain(stream, [("{full_prompt}", "getwebpage", "", "")], G.ChainContext(spark))


@pytest.mark.parametrize("text", [
    "WITH a AS (SELECT 1) INSERT OVERWRITE DIRECTORY '/tmp/out' USING parquet SELECT * FROM a", "FROM asked INSERT INTO t SELECT *",
    "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM text.`/etc/passwd`", "SELECT (SELECT count(*) FROM csv.`/etc`) FROM asked",
    "SELECT * FROM asked WHERE n IN (SELECT java_method('java.lang.System', 'nanoTime'))", "DROP TABLE asked", "SELECT 1; SELECT 2",
    "WITH a AS (SELECT * FROM json.`/x`) SELECT * FROM a", "SELECT * FROM nowhere", "CREATE TABLE x AS SELECT 1"])
def test_only_queries_over_views_are_accepted(spark, text):
    spark.range(3).toDF("n").createOrReplaceTempView("asked")
    assert A.ask(spark, text) == (None, A.FAILED_MSG)


def test_queries_over_views_are_accepted(spark):
    spark.range(3).toDF("n").createOrReplaceTempView("asked")
    for text in ("SELECT max(n) FROM asked", "WITH a AS (SELECT n FROM asked), b AS (SELECT * FROM a) SELECT * FROM b WHERE n IN (SELECT n FROM a)",
                 "FROM asked SELECT n", "(SELECT n FROM asked) UNION ALL (SELECT 5)", "SELECT ';' AS s, (SELECT count(*) FROM asked) AS c"):
        assert A.ask(spark, text)[0] is not None, text


def test_statements_fail_alone_and_are_repaired(spark):
    spark.createDataFrame([("1",), ("x",)], "n string").createOrReplaceTempView("df")
    statements = ["SELECT n, 1 AS k FROM df", "SELECT raise_error('no') AS a, 2 AS b FROM df", "SELECT missing FROM df", "SELECT count(*) FROM df"] * 3
    rows = [(i, "u", "s", i, s) for i, s in enumerate(statements)]
    prompts = spark.createDataFrame(rows, "row_id int, user_id string, session_id string, ts int, prompt string")
    asked = []

    def repair(statement, error):
        asked.append(statement)
        return "SELECT n, 7 AS k FROM df" if "missing" in statement else statement

    ctx = G.ChainContext(spark, user_tag="", assistant_tag="", repair=repair)
    got = {r["row_id"]: r["result"] for r in G.run_chain(prompts, [("{full_prompt}", "execute_df_expression", "", "")], ctx).collect()}
    assert len(asked) == 2                                # equal statements run once
    for i, text in got.items():
        kind = i % 4
        if kind == 1:
            assert text == A.FAILED_MSG
        elif kind == 3:
            assert text.endswith("\n2")
        else:
            assert "Number of Records: 2" in text and (kind == 0 or "7" in text)
    assert ctx.last_result is not None


def test_reports_of_tables_are_not_cut(spark):
    wide = spark.createDataFrame([("x" * 3000, i) for i in range(3)], "a string, b int")
    assert len(A.report(wide, "s", "n")["text"]) > 9000
    text = A.value_text(wide.select("a"), "s")
    assert "x" * A.VALUE_CHARS in text and "x" * (A.VALUE_CHARS + 1) not in text and A.value_text(wide, "s") is None


def test_store_rows_are_unique_by_key(spark):
    rows = [("u", "s", "n", f"t{i}", i) for i in range(5)]
    df = spark.createDataFrame(rows, "user_id string, session_id string, stored_result_name string, text string, o int")
    assert [r["text"] for r in E.memorize_results(df, None, "o").collect()] == ["t0"]


def test_options_keep_true_and_false(spark):
    steps = spark.createDataFrame([("a", "user_input", "{'x': True, 'y': False, 'z': None}", "next")], "input string, action string, option string, next_df string")
    assert G.compile_steps(steps).select("options").head()[0] == {"x": "true", "y": "false", "z": None}
