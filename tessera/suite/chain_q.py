"""Fixture queries: prompt chains (G2-G8) and batch completion (K1, K2) with a stub model."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tessera.functions.text import tag_prompt
from tessera.operators import ask as A
from tessera.operators import complete as K
from tessera.operators import memory as M
from tessera.plans import chain as G
from tessera.plans.presets import PRESETS, TRANSLATE_DE_ENG
from tessera.session import pinned, register_tables, scratch_path
from tessera.suite.common import T

FIRST6 = partial(K.edge_words_stub, 6)
LAST6 = partial(K.edge_words_stub, 6, True)


def _prompts(spark, sf):
    """Prompt dataset: user rows of conversations, ``row_id = conv_id * 1000 + turn``."""
    r = M.conversation_turns(T(spark, sf, "conversations"))
    return r.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "user_id", "session_id", "ts",
        F.col("text").alias("prompt"))


def _ctx(spark, factory=FIRST6, tags=("", "")):
    return G.ChainContext(spark, completer_factory=factory, user_tag=tags[0], assistant_tag=tags[1])


THREE_STEPS = [
    ("{full_prompt}", "llm_completion", "{'max_length': 486, 'temperature': 0.1}", "next"),
    ("Summarize: {result} for {full_prompt}", "llm_completion", "{'max_length': 50}", "next"),
    ("{result}", "no_such_action", "", "next"),
    ("{result}", "user_input", "{}", "next"),
]

_D_PROMPTS = ("p AS (SELECT conv_id * 1000 + turn AS row_id, 'u' || CAST(conv_id % 10 AS VARCHAR) AS user_id, "
              "'s' || CAST(conv_id AS VARCHAR) AS session_id, turn, text AS prompt FROM conversations "
              "WHERE role = 'user')")


def _d_first(x: str, n: int = 6) -> str:
    return f"array_to_string(string_split({x}, ' ')[1:{n}], ' ')"


_D_R2 = f"{_d_first(chr(39) + 'Summarize: ' + chr(39) + ' || ' + _d_first('prompt') + ' || ' + chr(39) + ' for ' + chr(39) + ' || prompt')}"


def g2_run_chain(spark, sf):
    out = G.run_chain(_prompts(spark, sf), THREE_STEPS, _ctx(spark))
    return out.select("row_id", F.md5("result").alias("result_md5"))


G2_SQL = f"WITH {_D_PROMPTS} SELECT row_id, md5({_D_R2}) AS result_md5 FROM p"


def g4_batch_report(spark, sf):
    out = G.batch_report(G.run_chain(_prompts(spark, sf), THREE_STEPS, _ctx(spark)))
    return out.select("row_id", F.md5("prompt").alias("prompt_md5"), F.md5("result").alias("result_md5"))


G4_SQL = f"WITH {_D_PROMPTS} SELECT row_id, md5(prompt) AS prompt_md5, md5({_D_R2}) AS result_md5 FROM p"


def g5_step_log(spark, sf):
    out = G.run_chain(_prompts(spark, sf), THREE_STEPS, _ctx(spark), log=True)
    lg = G.step_log(out)
    return lg.select("row_id", F.col("step_no").cast("bigint").alias("step_no"), "action",
                     F.md5("input").alias("input_md5"), F.md5("result").alias("result_md5"))


G5_SQL = f"""WITH {_D_PROMPTS},
s AS (SELECT row_id, prompt, {_d_first('prompt')} AS r1, {_D_R2} AS r2 FROM p)
SELECT row_id, 0::BIGINT AS step_no, 'llm_completion' AS action, md5(prompt) AS input_md5, md5(r1) AS result_md5 FROM s
UNION ALL SELECT row_id, 1, 'llm_completion', md5('Summarize: ' || r1 || ' for ' || prompt), md5(r2) FROM s
UNION ALL SELECT row_id, 3, 'user_input', md5(r2), md5(r2) FROM s"""

PROGRAM = {
    "ask": [("{full_prompt}", "llm_completion", "{}", "echo")],
    "echo": [("Echo {full_prompt}", "user_input", "{}", "next"), ("{result}", "user_input", "", "ask")],
}


def g3_run_program(spark, sf):
    out = G.run_program(_prompts(spark, sf), PROGRAM, "ask", _ctx(spark))
    return out.select("row_id", "table", F.md5("result").alias("result_md5"))


G3_SQL = f"""WITH {_D_PROMPTS},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY turn) - 1 AS pos FROM p)
SELECT row_id, CASE WHEN pos % 2 = 0 THEN 'ask' ELSE 'echo' END AS "table",
       md5(CASE WHEN pos % 2 = 0 THEN {_d_first('prompt')} ELSE 'Echo ' || prompt END) AS result_md5 FROM r"""


def _measure(df, inp, ctx, **_):
    return df.withColumn("result", F.concat(F.length(inp).cast("string"), F.lit(":"), inp))


def g6_register_action(spark, sf):
    G.register_action("measure", _measure, row_wise=True)
    out = G.run_chain(_prompts(spark, sf), [("{full_prompt}", "measure", "", "next")], _ctx(spark))
    return out.select("row_id", F.md5("result").alias("result_md5"))


G6_SQL = f"WITH {_D_PROMPTS} SELECT row_id, md5(CAST(length(prompt) AS VARCHAR) || ':' || prompt) AS result_md5 FROM p"

RESET_STEPS = [
    ("['{full_prompt}']", "user_input", "", "next"),
    ("{result}", "ResetFullPrompt", "", "next"),
    ("X {full_prompt} {{done}}", "user_input", "", "next"),
]


def g7_reset_full_prompt(spark, sf):
    out = G.run_chain(_prompts(spark, sf), RESET_STEPS, _ctx(spark, tags=("[User]: ", "[Assistant]: ")))
    return out.select("row_id", F.md5("result").alias("result_md5"))


G7_SQL = (f"WITH {_D_PROMPTS} SELECT row_id, md5('X ' || '[User]: ' || prompt || '[Assistant]: ' || ' {{done}}') "
          "AS result_md5 FROM p")


def g8_user_input(spark, sf):
    out = G.run_chain(_prompts(spark, sf), [("{full_prompt}|{result}", "user_input", "", "next")], _ctx(spark))
    return out.select("row_id", F.md5("result").alias("result_md5"))


G8_SQL = f"WITH {_D_PROMPTS} SELECT row_id, md5(prompt || '|None') AS result_md5 FROM p"


def k1_complete(spark, sf):
    d = T(spark, sf, "documents")
    ans = K.complete(tag_prompt("text"), LAST6, max_length=128, context_size=4096)
    return d.select("doc_id", F.md5(ans).alias("answer_md5"))


K1_SQL = ("WITH w AS (SELECT doc_id, '[User]: ' || text || '[Assistant]: ' AS p, "
          "string_split('[User]: ' || text || '[Assistant]: ', ' ') AS l FROM documents) "
          "SELECT doc_id, md5(CASE WHEN length(p) / 3.5 > 3968 "
          "THEN 'Error: The message is too long and exceeds the model''s token limit.' "
          "ELSE split_part(array_to_string(list_slice(l, greatest(len(l) - 5, 1), len(l)), ' '), '[User]:', 1) END) "
          "AS answer_md5 FROM w")


def k2_translate_preset(spark, sf):
    out = G.run_chain(_prompts(spark, sf), TRANSLATE_DE_ENG, _ctx(spark, LAST6))
    return out.select("row_id", F.md5("result").alias("result_md5"))


K2_SQL = (f"WITH {_D_PROMPTS}, w AS (SELECT row_id, string_split('Please translate the following text from german "
          "to english : ' || prompt, ' ') AS l FROM p) "
          "SELECT row_id, md5(array_to_string(list_slice(l, greatest(len(l) - 5, 1), len(l)), ' ')) AS result_md5 "
          "FROM w")

def g2_chain_with_memory(spark, sf):
    """The last prompt of every session after a memory of its earlier turns; then its turn is stored and read back."""
    path = scratch_path(spark, "memory")
    pairs = M.chat_pairs(M.conversation_turns(T(spark, sf, "conversations")))
    last = pairs.groupBy(*M.SESSION).agg(F.max("ts").alias("ts"))
    M.append_turns(pairs.join(last, [*M.SESSION, "ts"], "left_anti"), path)
    prompts = pairs.join(last, [*M.SESSION, "ts"]).select(
        F.substring("session_id", 2, 20).cast("bigint").alias("row_id"), *M.SESSION, "ts", F.col("user_prompt").alias("prompt"))
    ctx = G.ChainContext(spark, completer_factory=LAST6, context_size=1_000_000)
    out = pinned(G.run_chain(prompts, [("{full_prompt}", "user_input", "", "next")], ctx, memory=M.read_memory(spark, path)), "answers")
    G.store_turns(out, path, ctx)
    return M.session_history(M.read_memory(spark, path)).select("session_id", F.md5("history").alias("history_md5"))


#: every answer is the history before it, so the final history holds it twice; at most RELOAD_LIMIT turns are loaded
G2_MEMORY_SQL = f"""WITH c AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, '[User]: ' || text AS q, '[Assistant]: ' || CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS a,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WHERE role = 'user'),
e AS (SELECT conv_id, coalesce(string_agg(q || ' ' || a || ' ', '' ORDER BY turn) FILTER (back > 1), '') AS h,
        coalesce(string_agg(q || ' ' || a || ' ', '' ORDER BY turn) FILTER (back > 1 AND back <= {M.RELOAD_LIMIT} + 1), '') AS recent,
        max(q) FILTER (back = 1) AS q FROM p GROUP BY conv_id)
SELECT 's' || conv_id AS session_id, md5(h || q || ' [Assistant]: ' || recent || q || '[Assistant]:  ') AS history_md5 FROM e"""


def e2_recall_in_chain(spark, sf):
    """Every prompt's completion is memorized under its session; a later step of the same chain reads it back."""
    steps = [("{full_prompt}", "llm_completion", "{}", "next"), ("{result}", "MemorizeResult", "{'stored_result_name': 'first'}", "next"),
             ("other", "user_input", "", "next"), ("", "getMemoryResult", "{'stored_result_name': 'first'}", "next")]
    out = G.run_chain(_prompts(spark, sf), steps, _ctx(spark))
    return out.select("row_id", F.md5("result").alias("result_md5"))


E2_CHAIN_SQL = f"""WITH {_D_PROMPTS}
SELECT row_id, md5(first_value({_d_first('prompt')}) OVER (PARTITION BY user_id, session_id ORDER BY row_id)) AS result_md5 FROM p"""

_GOOD, _BAD, _WORSE = ("SELECT count(*) AS n FROM lineitem", "SELECT count(l_missing) AS n FROM lineitem",
                       "SELECT raise_error('never') AS n FROM lineitem")


def i2_chain_repair(spark, sf):
    """One statement per prompt: a right one, one that its repair makes right, and one that fails while it runs."""
    register_tables(spark, sf, ["lineitem"])
    pick = F.pmod(F.floor(F.col("row_id") / 1000), F.lit(3))
    prompts = _prompts(spark, sf).withColumn("prompt", F.when(pick == 0, _GOOD).when(pick == 1, _BAD).otherwise(_WORSE))
    ctx = _ctx(spark)
    ctx.views = ("lineitem",)
    ctx.repair = lambda statement, error: statement.replace("l_missing", "*")
    out = G.run_chain(prompts, [("{full_prompt}", "execute_df_expression", "", "next")], ctx)
    return out.select("row_id", "result")


I2_CHAIN_SQL = f"""SELECT conv_id * 1000 + turn AS row_id, CASE WHEN conv_id % 3 = 2 THEN '{A.FAILED_MSG}'
  ELSE 'Executing the expression: {_GOOD} produced the following result:' || chr(10) || (SELECT count(*) FROM lineitem) END AS result
FROM conversations WHERE role = 'user'"""


_TABLE = "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag"


def i3_report_text(spark, sf):
    """The whole report of a saved table, for every region's prompt."""
    register_tables(spark, sf, ["lineitem"])
    prompts = T(spark, sf, "region").select(F.col("r_regionkey").alias("row_id"), F.lit("u").alias("user_id"), F.col("r_name").alias("session_id"),
                                            F.lit(_TABLE).alias("prompt"))
    ctx = _ctx(spark)
    ctx.views = ("lineitem",)
    out = G.run_chain(prompts, [("{full_prompt}", "execute_df_expression", "", "next")], ctx)
    return out.select("row_id", "result")


I3_TEXT_SQL = f"""WITH t AS ({_TABLE}) SELECT r_regionkey AS row_id,
  'Executing the expression: {_TABLE} saved as last_result produced the following table:' || chr(10) || chr(10) || 'Dataframe 5 first rows'
  || chr(10) || '| l_returnflag | n |' || chr(10) || '|---|---|' || chr(10)
  || (SELECT string_agg('| ' || l_returnflag || ' | ' || n || ' |' || chr(10), '' ORDER BY l_returnflag) FROM t)
  || repeat(chr(10), 3) || 'Number of Records: ' || (SELECT count(*) FROM t) || chr(10) AS result FROM region"""


def k2_distinct_counts(spark, sf):
    """The distinct-count preset over the active table."""
    T(spark, sf, "nation").select("n_regionkey", "n_nationkey").createOrReplaceTempView("df")
    out = G.run_chain(_prompts(spark, sf), PRESETS["distinct_counts"], _ctx(spark))
    return out.select("row_id", "result")


K2_COUNTS_SQL = """SELECT conv_id * 1000 + turn AS row_id, '| column | distinct values |' || chr(10) || '|---|---|' || chr(10)
  || '| n_regionkey | ' || (SELECT count(DISTINCT n_regionkey) FROM nation) || ' |' || chr(10)
  || '| n_nationkey | ' || (SELECT count(DISTINCT n_nationkey) FROM nation) || ' |' || chr(10) AS result
FROM conversations WHERE role = 'user'"""

QUERIES = {
    "G2_chain_with_memory": (g2_chain_with_memory, G2_MEMORY_SQL),
    "E2_recall_in_chain": (e2_recall_in_chain, E2_CHAIN_SQL),
    "I2_chain_repair": (i2_chain_repair, I2_CHAIN_SQL),
    "I3_report_text": (i3_report_text, I3_TEXT_SQL),
    "K2_distinct_counts": (k2_distinct_counts, K2_COUNTS_SQL),
    "G2_run_chain": (g2_run_chain, G2_SQL),
    "G3_run_program": (g3_run_program, G3_SQL),
    "G4_batch_report": (g4_batch_report, G4_SQL),
    "G5_step_log": (g5_step_log, G5_SQL),
    "G6_register_action": (g6_register_action, G6_SQL),
    "G7_reset_full_prompt": (g7_reset_full_prompt, G7_SQL),
    "G8_user_input": (g8_user_input, G8_SQL),
    "K1_complete": (k1_complete, K1_SQL),
    "K2_translate_preset": (k2_translate_preset, K2_SQL),
}
