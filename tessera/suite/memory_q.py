"""Fixture queries: filters (C), result store (E), conversation memory (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import filters as C
from tessera.operators import memory as M
from tessera.operators import results as E
from tessera.suite.common import T


def _rows(spark, sf):
    return M.conversation_turns(T(spark, sf, "conversations"))


def _pairs(spark, sf):
    return M.chat_pairs(_rows(spark, sf))


D_TURNS = """turns AS (SELECT 'u' || CAST(conv_id % 10 AS VARCHAR) AS user_id, 's' || CAST(conv_id AS VARCHAR) AS session_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS ts, conv_id, turn, role, text FROM conversations)"""
D_PAIRS = D_TURNS + """,
pairs AS (SELECT user_id, session_id, ts, text AS user_prompt,
                 CASE WHEN nrole = 'assistant' THEN ntext ELSE '' END AS llm_answer
          FROM (SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS ntext FROM turns
                WINDOW w AS (PARTITION BY user_id, session_id ORDER BY ts)) WHERE role = 'user')"""

# C ---------------------------------------------------------------------------


def c1_where_eq(spark, sf):
    return C.where_eq(T(spark, sf, "lineitem"), l_returnflag="R", l_linestatus="F").select(
        "l_orderkey", "l_linenumber")


C1_SQL = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'"


def c2_where_in(spark, sf):
    return C.where_in(T(spark, sf, "documents"), "doc_id", T(spark, sf, "labels").select("doc_id")).select(
        "doc_id", "lang")


C2_SQL = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def c3_first_n(spark, sf):
    return C.first_n(T(spark, sf, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10).select(
        "o_orderkey", "o_totalprice")


C3_SQL = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"


def c4_ordered_text(spark, sf):
    t = C.ordered_text(_rows(spark, sf), M.SESSION, "ts", "text", "\n")
    return t.select(*M.SESSION, F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


C4_SQL = f"""WITH {D_TURNS},
g AS (SELECT user_id, session_id, string_agg(text, chr(10) ORDER BY ts) AS t FROM turns GROUP BY ALL)
SELECT user_id, session_id, md5(t) AS text_md5, length(t)::BIGINT AS n_chars FROM g"""

# E ---------------------------------------------------------------------------


def _results(spark, sf):
    r = _rows(spark, sf)
    return r.select(*M.SESSION, F.concat(F.lit("r"), F.pmod("turn", F.lit(3)).cast("string")).alias(
        "stored_result_name"), "text", "ts", "role")


def _store(spark, sf):
    r = _results(spark, sf)
    initial = E.memorize_results(r.filter(F.col("role") == "assistant"), None)
    return E.store_after(r, initial)


def e1_memorize(spark, sf):
    s = _store(spark, sf)
    return s.select("id", *E.RESULT_KEY, F.md5("text").alias("text_md5"))


D_STORE = D_TURNS + """,
r AS (SELECT user_id, session_id, 'r' || CAST(turn % 3 AS VARCHAR) AS stored_result_name, text, ts, role FROM turns),
init AS (SELECT user_id, session_id, stored_result_name, arg_min(text, ts) AS text FROM r
         WHERE role = 'assistant' GROUP BY ALL),
batch AS (SELECT user_id, session_id, stored_result_name, arg_min(text, ts) AS text FROM r GROUP BY ALL),
store AS (SELECT * FROM init UNION ALL
          SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM init i WHERE i.user_id = b.user_id
                 AND i.session_id = b.session_id AND i.stored_result_name = b.stored_result_name))"""

E1_SQL = f"""WITH {D_STORE}
SELECT user_id || '_' || session_id || '_' || stored_result_name AS id, user_id, session_id, stored_result_name,
       md5(text) AS text_md5 FROM store"""


def e2_recall(spark, sf):
    keys = (_rows(spark, sf).select(*M.SESSION).distinct()
            .select(*M.SESSION, F.explode(F.array(*[F.lit(f"r{i}") for i in range(3)])).alias("stored_result_name")))
    got = E.recall_results(keys, _store(spark, sf))
    return got.select(*E.RESULT_KEY, F.md5("text").alias("text_md5"))


E2_SQL = f"""WITH {D_STORE},
keys AS (SELECT DISTINCT user_id, session_id, unnest(['r0', 'r1', 'r2']) AS stored_result_name FROM turns)
SELECT k.user_id, k.session_id, k.stored_result_name, md5(s.text) AS text_md5
FROM keys k LEFT JOIN store s USING (user_id, session_id, stored_result_name)"""

# F ---------------------------------------------------------------------------


def f1_append_turns(spark, sf):
    from tessera.session import scratch_path

    path = scratch_path(spark, "memory")
    pairs = _pairs(spark, sf)
    M.append_turns(pairs, path)
    M.append_turns(pairs, path)  # a retried batch adds nothing
    mem = M.read_memory(spark, path)
    return mem.select(*M.SESSION, "ts", F.md5("user_prompt").alias("prompt_md5"),
                      F.md5("llm_answer").alias("answer_md5"))


F1_SQL = f"""WITH {D_PAIRS}
SELECT user_id, session_id, ts, md5('[User]: ' || user_prompt) AS prompt_md5,
       md5('[Assistant]: ' || llm_answer) AS answer_md5 FROM pairs"""


def f2_session_history(spark, sf):
    h = M.session_history(_pairs(spark, sf))
    return h.select(*M.SESSION, F.md5("history").alias("history_md5"),
                    F.length("history").cast("bigint").alias("n_chars"))


F2_SQL = f"""WITH {D_PAIRS},
h AS (SELECT user_id, session_id, string_agg(user_prompt || ' ' || llm_answer || ' ', '' ORDER BY ts) AS h
      FROM pairs GROUP BY ALL)
SELECT user_id, session_id, md5(h) AS history_md5, length(h)::BIGINT AS n_chars FROM h"""

F3_BUDGET = 300


def f3_sliding_memory(spark, sf):
    return M.sliding_memory(_pairs(spark, sf), F3_BUDGET).select(*M.SESSION, "ts", "suffix_chars")


F3_SQL = f"""WITH {D_PAIRS},
s AS (SELECT user_id, session_id, ts,
             sum(length(user_prompt) + length(llm_answer) + 2) OVER (PARTITION BY user_id, session_id ORDER BY ts DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS suffix_chars FROM pairs)
SELECT * FROM s WHERE suffix_chars / 3.5 <= {F3_BUDGET}"""


def f4_prompt_with_history(spark, sf):
    p = M.prompt_with_history(_pairs(spark, sf))
    return p.select(*M.SESSION, "ts", F.md5("full_prompt").alias("prompt_md5"),
                    F.length("full_prompt").cast("bigint").alias("n_chars"))


F4_SQL = f"""WITH {D_PAIRS},
b AS (SELECT user_id, session_id, ts, user_prompt,
             coalesce(string_agg(user_prompt || ' ' || llm_answer || ' ', '') OVER (PARTITION BY user_id, session_id
                 ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM pairs),
f AS (SELECT user_id, session_id, ts,
             regexp_replace(before, '^[ \\t\\r\\n\\f\\x0b]+', '') || ' ' || '[User]: ' || user_prompt || '[Assistant]: ' AS p
      FROM b)
SELECT user_id, session_id, ts, md5(p) AS prompt_md5, length(p)::BIGINT AS n_chars FROM f"""


def f5_load_sessions(spark, sf):
    rows = _pairs(spark, sf)
    got = M.load_sessions(rows, rows.select(*M.SESSION), n=3, latest=True)
    return got.select(*M.SESSION, "ts", F.md5("user_prompt").alias("prompt_md5"))


F5_SQL = f"""WITH {D_PAIRS}
SELECT user_id, session_id, ts, md5(user_prompt) AS prompt_md5 FROM pairs
QUALIFY row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts DESC) <= 3"""


def f6_sessions_of(spark, sf):
    rows = _rows(spark, sf)
    return M.sessions_of(rows, rows.select("user_id"))


F6_SQL = f"""WITH {D_TURNS} SELECT DISTINCT user_id, session_id FROM turns"""


def f7_chat_pairs(spark, sf):
    return _pairs(spark, sf).select(*M.SESSION, "ts", F.md5("user_prompt").alias("prompt_md5"),
                                    F.md5("llm_answer").alias("answer_md5"))


F7_SQL = f"""WITH {D_PAIRS}
SELECT user_id, session_id, ts, md5(user_prompt) AS prompt_md5, md5(llm_answer) AS answer_md5 FROM pairs"""


def f8_drop_last_turn(spark, sf):
    rows = _rows(spark, sf)
    return M.drop_last_turn(rows, rows.select(*M.SESSION)).select(*M.SESSION, "ts", "role")


F8_SQL = f"""WITH {D_TURNS}
SELECT user_id, session_id, ts, role FROM turns t
WHERE ts < (SELECT max(ts) FROM turns m WHERE m.user_id = t.user_id AND m.session_id = t.session_id)"""


def f9_archive_sessions(spark, sf):
    a = M.archive_sessions(_pairs(spark, sf))
    return a.select(*M.SESSION, "summary",
                    F.json_array_length(F.get_json_object("document", "$.turns")).cast("bigint").alias("n_turns"))


F9_SQL = f"""WITH {D_PAIRS}
SELECT user_id, session_id, 'Placeholder summary of the session.' AS summary, count(*)::BIGINT AS n_turns
FROM pairs GROUP BY ALL"""


def _turn_docs(spark, sf):
    r = _rows(spark, sf)
    doc = (F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("user_prompt"),
                                                               F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
                                                               .alias("timestamp"))))
           .when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("llm_answer"))))
           .otherwise(F.col("text")))
    return r.select("conv_id", "turn", doc.alias("document"))


def f10_parse_turns(spark, sf):
    p = M.parse_turns(_turn_docs(spark, sf))
    return p.select("conv_id", "turn", F.md5("user_prompt").alias("prompt_md5"),
                    F.md5("llm_answer").alias("answer_md5"), "timestamp")


F10_SQL = f"""WITH {D_TURNS},
d AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN json_object('user_prompt', text,
             'timestamp', strftime(ts, '%Y-%m-%d %H:%M:%S'))::VARCHAR
           WHEN role = 'assistant' THEN json_object('llm_answer', text)::VARCHAR ELSE text END AS document FROM turns)
SELECT conv_id, turn, md5(coalesce(json_extract_string(document, '$.user_prompt'), '')) AS prompt_md5,
       md5(coalesce(json_extract_string(document, '$.llm_answer'), '')) AS answer_md5,
       coalesce(json_extract_string(document, '$.timestamp'), '') AS timestamp
FROM d WHERE json_valid(document)"""


def f11_new_session_id(spark, sf):
    return T(spark, sf, "events").select("event_id", M.new_session_id("ts").alias("session_id"))


F11_SQL = "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S%f') || '_Session' AS session_id FROM events"

QUERIES = {
    "C1_where_eq": (c1_where_eq, C1_SQL),
    "C2_where_in": (c2_where_in, C2_SQL),
    "C3_first_n": (c3_first_n, C3_SQL),
    "C4_ordered_text": (c4_ordered_text, C4_SQL),
    "E1_memorize_results": (e1_memorize, E1_SQL),
    "E2_recall_results": (e2_recall, E2_SQL),
    "F1_append_turns": (f1_append_turns, F1_SQL),
    "F2_session_history": (f2_session_history, F2_SQL),
    "F3_sliding_memory": (f3_sliding_memory, F3_SQL),
    "F4_prompt_with_history": (f4_prompt_with_history, F4_SQL),
    "F5_load_sessions": (f5_load_sessions, F5_SQL),
    "F6_sessions_of": (f6_sessions_of, F6_SQL),
    "F7_chat_pairs": (f7_chat_pairs, F7_SQL),
    "F8_drop_last_turn": (f8_drop_last_turn, F8_SQL),
    "F9_archive_sessions": (f9_archive_sessions, F9_SQL),
    "F10_parse_turns": (f10_parse_turns, F10_SQL),
    "F11_new_session_id": (f11_new_session_id, F11_SQL),
}
