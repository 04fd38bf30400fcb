"""Shipped step tables, kept as data (rows of input, action, option, next_df).

The last row's ``next_df`` names the preset that handles the next prompt, by
its key in ``PRESETS`` (``run_program`` routes with it).
"""

from __future__ import annotations

# Fixed values that must equal the reference's for right results: preset chains.
DEFAULT_SEQ = [
    ("{full_prompt}", "llm_completion", "{'max_length': 486, 'temperature': 0.1}", "next"),
    ("{result}", "user_input", "{}", "default"),
]
TRANSLATE_DE_ENG = [
    ("Please translate the following text from german to english : {full_prompt}", "llm_completion",
     "{'max_length': 1024, 'temperature': 0.1}", "next"),
    ("{result}", "user_input", "{}", "translate_de_eng"),
]
CSV_PEEK = [
    ("{full_prompt}", "csv_peek", "{}", "default"),
]

# Presets of this library (own wording) --------------------------------------
ASK_SQL = [
    ("{full_prompt}", "csv_peek", "{}", "next"),
    ("{result}\n\nWrite a Spark SQL query on the view df for this question and reply with JSON holding it under the "
     "key df. Question: {full_prompt}", "llm_completion",
     "{'max_length': 200, 'temperature': 0.1, 'grammar': 'singleexpression'}", "next"),
    ("{result}", "execute_df_expression", "{}", "next"),
    ("{result}", "user_input", "{}", "ask_sql"),
]
SEARCH_ANSWER = [
    ("{full_prompt}", "internet_search", "{}", "next"),
    ("Choose three pages from these notes that help with the request and give their addresses as JSON with the keys Url_1, "
     "Url_2 and Url_3.\n{result}\nRequest: {full_prompt}", "llm_completion",
     "{'max_length': 150, 'temperature': 0.1, 'grammar': 'urllist'}", "next"),
    ("{result}", "getwebpage", "{}", "next"),
    ("Answer the request from this page.\n{result}\nRequest: {full_prompt}", "llm_completion",
     "{'max_length': 486, 'temperature': 0.1}", "next"),
    ("{result}", "user_input", "{}", "search_answer"),
]
DISTINCT_COUNTS = [
    ("{full_prompt}", "distinct_counts", "{}", "next"),
    ("{result}", "user_input", "{}", "distinct_counts"),
]

PRESETS = {"default": DEFAULT_SEQ, "translate_de_eng": TRANSLATE_DE_ENG, "csv_peek": CSV_PEEK, "ask_sql": ASK_SQL,
           "search_answer": SEARCH_ANSWER, "distinct_counts": DISTINCT_COUNTS}
