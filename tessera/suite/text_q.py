"""Fixture queries: scalar text functions (B1-B14) and guided output checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import guided as G
from tessera.functions import text as X
from tessera.functions.template import render
from tessera.operators import memory as M
from tessera.suite.common import T, d_strip

# B ---------------------------------------------------------------------------


def b1_count_tokens(spark, sf):
    return T(spark, sf, "documents").select("doc_id", F.round(X.count_tokens("text"), 6).alias("tokens"))


B1_SQL = "SELECT doc_id, round(length(text) / 3.5, 6) AS tokens FROM documents"


def b2_budget_gate(spark, sf):
    g = X.budget_gate("text", 4096, 128)
    return T(spark, sf, "documents").select("doc_id", F.md5(g).alias("gated_md5"))


B2_SQL = ("SELECT doc_id, md5(CASE WHEN length(text) / 3.5 > 3968 THEN "
          "'Error: The message is too long and exceeds the model''s token limit.' ELSE text END) AS gated_md5 "
          "FROM documents")

B3_TEMPLATE = "  {{step}} Answer {full_prompt} given {result}.  "


def b3_render(spark, sf):
    r = M.conversation_turns(T(spark, sf, "conversations"))
    out = render(B3_TEMPLATE, full_prompt=F.col("text"), result=F.when(F.col("role") == "user", F.lit(None))
                 .otherwise(F.lit("{result}")))
    return r.select("conv_id", "turn", F.md5(out).alias("rendered_md5"))


B3_SQL = ("SELECT conv_id, turn, md5('{step} Answer ' || text || ' given ' || "
          "CASE WHEN role = 'user' THEN 'None' ELSE '{result}' END || '.') AS rendered_md5 FROM conversations")


def b4_tag_prompt(spark, sf):
    return T(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.tag_prompt("text")).alias("tagged_md5"))


B4_SQL = "SELECT conv_id, turn, md5('[User]: ' || text || '[Assistant]: ') AS tagged_md5 FROM conversations"


def b5_is_valid_json(spark, sf):
    ev = T(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("props").alias("src"),
                                       X.is_valid_json("props").alias("valid"))
    cv = T(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                                              F.lit("conversation").alias("src"), X.is_valid_json("text").alias("valid"))
    return ev.unionByName(cv)


B5_SQL = ("SELECT event_id AS id, 'props' AS src, coalesce(json_valid(props), false) AS valid FROM events UNION ALL "
          "SELECT conv_id * 1000 + turn, 'conversation', coalesce(json_valid(text), false) FROM conversations")


def b6_is_valid_url(spark, sf):
    p = T(spark, sf, "pages")
    return p.select("page_id", X.is_valid_url("url").alias("valid"),
                    X.is_valid_url(F.substring_index("url", "://", -1)).alias("valid_without_scheme"),
                    X.is_valid_url(F.regexp_replace("url", "://[^/?#]*", "://")).alias("valid_without_host"))


B6_SQL = (f"SELECT page_id, coalesce(regexp_matches(url, '{X.URL_PATTERN}'), false) AS valid, "
          f"coalesce(regexp_matches(split_part(url, '://', -1), '{X.URL_PATTERN}'), false) AS valid_without_scheme, "
          f"coalesce(regexp_matches(regexp_replace(url, '://[^/?#]*', '://'), '{X.URL_PATTERN}'), false) "
          "AS valid_without_host FROM pages")


def b7_content_hash(spark, sf):
    return T(spark, sf, "documents").select("doc_id", X.content_hash("text").alias("content_hash"))


B7_SQL = "SELECT doc_id, md5(text) AS content_hash FROM documents"


def b8_unwrap(spark, sf):
    ev = T(spark, sf, "events").select(F.col("event_id").alias("id"), X.unwrap("props", "k").alias("value"))
    cv = T(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
                                              F.md5(X.unwrap("text", "k")).alias("value"))
    return ev.unionByName(cv)


B8_SQL = (f"SELECT event_id AS id, CASE WHEN json_valid(props) THEN coalesce(json_extract_string(props, '$.k'), '') "
          f"ELSE {d_strip('props')} END AS value FROM events UNION ALL "
          f"SELECT conv_id * 1000 + turn, md5(CASE WHEN coalesce(json_valid(text), false) "
          f"THEN coalesce(json_extract_string(text, '$.k'), '') ELSE {d_strip('text')} END) FROM conversations")


def b9_strip_list(spark, sf):
    c = T(spark, sf, "conversations")
    wrapped = F.when(F.col("role") == "user", F.concat(F.lit("['"), "text", F.lit("']"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(X.strip_list(wrapped)).alias("guarded_md5"),
                    F.md5(X.strip_list("text", guarded=False)).alias("cut_md5"))


B9_SQL = ("SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN text ELSE text END) AS guarded_md5, "
          "md5(CASE WHEN length(text) >= 4 THEN substr(text, 3, length(text) - 4) ELSE '' END) AS cut_md5 "
          "FROM conversations")


def b10_remove_suffix(spark, sf):
    c = T(spark, sf, "conversations")
    t = F.when(F.col("role") == "assistant", F.concat("text", F.lit("[stop]"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.md5(X.remove_suffix(t)).alias("out_md5"))


B10_SQL = ("SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' OR suffix(text, '[stop]') THEN text "
           "ELSE 'Error: String does not finish with [stop].' END) AS out_md5 FROM conversations")


def b11_flatten_ids(spark, sf):
    c = T(spark, sf, "conversations")
    nested = F.array(F.array("conv_id"), F.array("turn", "conv_id"))
    return c.select("conv_id", "turn", F.array_join(X.flatten_ids(nested), ",").alias("ids"))


B11_SQL = ("SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ',' || "
           "CAST(conv_id AS VARCHAR) AS ids FROM conversations")


def b12_truncate(spark, sf):
    d = T(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.truncate("text", 2000)).alias("marked_md5"),
                    F.length(X.truncate("text", 7500, "")).cast("bigint").alias("cut_chars"))


B12_SQL = ("SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || "
           "'[Content truncated due to length]' ELSE text END) AS marked_md5, "
           "least(length(text), 7500)::BIGINT AS cut_chars FROM documents")


def b13_cut_completion(spark, sf):
    c = T(spark, sf, "conversations")
    raw = F.concat("text", F.lit(" [User]: next question"))
    return c.select("conv_id", "turn", F.md5(X.cut_completion(raw, max_tokens=20)).alias("cut_md5"))


B13_SQL = ("SELECT conv_id, turn, md5(array_to_string(string_split(split_part(text || ' [User]: next question', "
           "'[User]:', 1), ' ')[1:20], ' ')) AS cut_md5 FROM conversations")


def b14_as_text(spark, sf):
    lab = T(spark, sf, "labels")
    return lab.select("doc_id", X.as_text(F.when(F.col("quality") != 0, F.col("quality"))).alias("quality_text"))


B14_SQL = ("SELECT doc_id, coalesce(CAST(CASE WHEN quality <> 0 THEN quality END AS VARCHAR), 'None') AS quality_text "
           "FROM labels")

# J ---------------------------------------------------------------------------
K_SCHEMA = {"type": "object", "properties": {"k": {"type": "integer"}}}
K_RX = G.schema_regex(K_SCHEMA, dialect="re2")


def _variants(spark, sf):
    e = T(spark, sf, "events")
    vs = [("as_is", F.col("props")), ("no_space", F.regexp_replace("props", " ", "")),
          ("two_spaces", F.regexp_replace("props", ": ", ":  ")), ("newline", F.concat("props", F.lit("\n"))),
          ("other_key", F.regexp_replace("props", '"k"', '"j"')), ("cut", F.substring("props", 2, 1000))]
    return e.select("event_id", "event_type", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"),
                                                                            v.alias("text")) for n, v in vs]))
                    .alias("v")).select("event_id", "event_type", "v.variant", "v.text")


_D_VARIANTS = """v AS (
  SELECT event_id, event_type, 'as_is' AS variant, props AS text FROM events UNION ALL
  SELECT event_id, event_type, 'no_space', replace(props, ' ', '') FROM events UNION ALL
  SELECT event_id, event_type, 'two_spaces', replace(props, ': ', ':  ') FROM events UNION ALL
  SELECT event_id, event_type, 'newline', props || chr(10) FROM events UNION ALL
  SELECT event_id, event_type, 'other_key', replace(props, '"k"', '"j"') FROM events UNION ALL
  SELECT event_id, event_type, 'cut', substr(props, 2, 1000) FROM events)"""


def _d_full(col: str, rx: str) -> str:
    return f"coalesce(regexp_full_match({col}, '{rx.replace(chr(39), chr(39) * 2)}'), false)"


def j1_conforms(spark, sf):
    v = _variants(spark, sf)
    return v.select("event_id", "variant", G.conforms("text", K_SCHEMA).alias("ok"))


J1_SQL = f"WITH {_D_VARIANTS} SELECT event_id, variant, {_d_full('text', K_RX)} AS ok FROM v"


def j2_parse_guided(spark, sf):
    p = G.parse_guided(T(spark, sf, "events"), "props", K_SCHEMA)
    return p.select("event_id", F.col("parsed.k").alias("k"))


J2_SQL = (f"SELECT event_id, CASE WHEN {_d_full('props', K_RX)} THEN json_extract(props, '$.k')::BIGINT END AS k "
          "FROM events")

#: a text of every shipped format, built around a customer (``{k}`` key, ``{n}`` name, ``{b}`` true or false); ids 0 mod 3
#: lose their closing brace, ids 1 mod 3 are spaced as the strict formats do not allow
J3_TEXTS = {
    "singleexpression": '{"df": "SELECT {k}"}',
    "urllist": '{"Url_1": "http://a/{k}", "Url_2": "{n}", "Url_3": ""}',
    "python_script": '{"body": "return {k}", "function_name": "f", "parameters": [{"default": "{k}", "name": "{n}", "type": "int"}], "return_type": "int"}',
    "student": '{"age": {k}, "isStudent": {b}, "name": "{n}"}',
    "cars": '{"age": {k}.5, "courses": ["{n}", "x"], "is_student": {b}, "name": "{n}"}',
    "example1": '{"age": {k}, "is_active": {b}, "name": "{n}"}',
    "news": '{"title": "{n}", "subtitle": "", "author": "{k}", "date": "d", "content": "c", "tags": [], "references": ["{n}", "r"]}',
    "delivery": '{"tracking_number": "{k}", "status": "{n}", "weight": "1", "submitted_ts": "{b}"}',
}
J3_LOOSE = tuple(G.NAMED_LOOSE)


def j3_named_formats(spark, sf):
    """Each of the eight formats against the texts of all eight."""
    c = T(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("n"))
    made = []
    for name, text in J3_TEXTS.items():
        out = F.lit(text)
        for mark, value in (("{k}", F.col("id").cast("string")), ("{n}", F.col("n")), ("{b}", (F.col("id") % 2 == 0).cast("string"))):
            out = F.replace(out, F.lit(mark), value)
        out = F.when(F.col("id") % 3 == 0, F.left(out, F.length(out) - 1)).when(F.col("id") % 3 == 1, F.replace(out, F.lit('": '), F.lit('":  '))) \
            .otherwise(out)
        made.append(F.struct(F.lit(name).alias("src"), out.alias("out")))
    checks = F.array(*[F.struct(F.lit(f).alias("fmt"), G.conforms("out", regex=G.named_regex(f)).alias("ok")) for f in J3_TEXTS])
    outs = c.select("id", F.inline(F.array(*made)))
    return outs.select("src", "id", F.inline(checks))


#: a whole text follows its own format only; the loose ones take any spaces
J3_SQL = f"""SELECT s.src, c_custkey AS id, f.fmt, s.src = f.fmt AND c_custkey % 3 <> 0
  AND (c_custkey % 3 = 2 OR s.src IN ({", ".join(f"'{x}'" for x in J3_LOOSE)})) AS ok
FROM customer, (SELECT unnest([{", ".join(f"'{x}'" for x in J3_TEXTS)}]) AS src) s, (SELECT unnest([{", ".join(f"'{x}'" for x in J3_TEXTS)}]) AS fmt) f"""


def j4_conformance_stats(spark, sf):
    st = G.conformance_stats(_variants(spark, sf), "text", K_SCHEMA, by=["event_type", "variant"])
    return st


J4_SQL = (f"WITH {_D_VARIANTS} SELECT event_type, variant, count_if(json_valid(text))::BIGINT AS n_valid_json, "
          f"count_if({_d_full('text', K_RX)})::BIGINT AS n_conforming, "
          f"count_if(NOT coalesce(json_valid(text), false) AND NOT {_d_full('text', K_RX)})::BIGINT AS n_neither, "
          "count(*) AS n FROM v GROUP BY ALL")

_CHOICE = {"oneOf": [{"type": "object", "properties": {"k": {"type": "integer"}}}, {"type": "number"}, {"type": "null"}]}


def j2_alternatives(spark, sf):
    """Texts that are an object, a number, null or none of these, typed by the alternative they follow."""
    text = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN cast(event_id * 0.5 AS string) WHEN 2 THEN 'null' ELSE concat(props, ',') END")
    p = G.parse_guided(T(spark, sf, "events").select("event_id", text.alias("t")), "t", _CHOICE)
    c = F.col("parsed")
    return p.select("event_id", c["branch"].alias("branch"), G.alternative(c, _CHOICE, 0)["k"].alias("k"), G.alternative(c, _CHOICE, 1).alias("x"))


J2_ALTERNATIVES_SQL = f"""SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN CASE WHEN {_d_full('props', K_RX)} THEN 0 END WHEN 1 THEN 1 WHEN 2 THEN 2 END AS branch,
  CASE WHEN event_id % 4 = 0 AND {_d_full('props', K_RX)} THEN json_extract(props, '$.k')::BIGINT END AS k,
  CASE WHEN event_id % 4 = 1 THEN event_id * 0.5::DOUBLE END AS x FROM events"""

QUERIES = {
    "B1_count_tokens": (b1_count_tokens, B1_SQL),
    "B2_budget_gate": (b2_budget_gate, B2_SQL),
    "B3_render": (b3_render, B3_SQL),
    "B4_tag_prompt": (b4_tag_prompt, B4_SQL),
    "B5_is_valid_json": (b5_is_valid_json, B5_SQL),
    "B6_is_valid_url": (b6_is_valid_url, B6_SQL),
    "B7_content_hash": (b7_content_hash, B7_SQL),
    "B8_unwrap": (b8_unwrap, B8_SQL),
    "B9_strip_list": (b9_strip_list, B9_SQL),
    "B10_remove_suffix": (b10_remove_suffix, B10_SQL),
    "B11_flatten_ids": (b11_flatten_ids, B11_SQL),
    "B12_truncate": (b12_truncate, B12_SQL),
    "B13_cut_completion": (b13_cut_completion, B13_SQL),
    "B14_as_text": (b14_as_text, B14_SQL),
    "J1_conforms": (j1_conforms, J1_SQL),
    "J2_parse_guided": (j2_parse_guided, J2_SQL),
    "J2_alternatives": (j2_alternatives, J2_ALTERNATIVES_SQL),
    "J3_named_formats": (j3_named_formats, J3_SQL),
    "J4_conformance_stats": (j4_conformance_stats, J4_SQL),
}
