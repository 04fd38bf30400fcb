"""Fixture queries for web pages (H1-H4) with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import URL_PATTERN
from tessera.operators import pages as P
from tessera.plans import chain as G
from tessera.suite.common import T


def _q(s: str) -> str:
    return s.replace("'", "''")


# The twin reads the fixture pages with flat patterns (RE2): they nest nothing inside removed or selected elements.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
            ("&copy;", "©"), ("&middot;", "·"), ("&reg;", "®"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
            ("&amp;", "&"))
NODE_WS = "[ \t\r\n\f\x0b\u00a0]"
D_TAG = r"<[/!?]?[A-Za-z][^>]*>"


def _flat(tag: str, attrs: str = "[^>]*") -> str:
    return rf"<{tag}\b{attrs}>.*?</{tag}>"


def _with_class(*names: str) -> str:
    return rf"[^>]*\bclass=\"(?:[^\"]* )?(?:{'|'.join(names)})(?: [^\"]*)?\"[^>]*"


D_REMOVED = "(?is)" + "|".join([r"<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"]
                               + [_flat(t) for t in P.REMOVED_TAGS]
                               + [_flat(t, _with_class(*P.REMOVED_CLASSES)) for t in ("div", "section", "aside", "span", "ul", "p")])
D_ARTICLE, D_MAIN = "(?is)" + _flat("article"), "(?is)" + _flat("div", _with_class(P.MAIN_CLASS))


def d_text_of(fragment: str) -> str:
    t = "t"
    for ent, ch in ENTITIES:
        t = f"replace({t}, '{_q(ent)}', '{_q(ch)}')"
    node = f"regexp_replace({t}, '^{NODE_WS}+|{NODE_WS}+$', '', 'g')"
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({fragment}, '{D_TAG}'), "
            f"lambda t: {node}), lambda t: length(t) > 0), '')")


def d_main_text_ctes(src: str = "pages", name: str = "mt", limit: int | None = P.WEB_TEXT_CHARS) -> str:
    """CTEs ending in ``{name}(page_id, url, html, text)``."""
    text = d_text_of("focus") if limit is None else f"substr({d_text_of('focus')}, 1, {limit})"
    return f"""{name}0 AS (SELECT page_id, url, html, regexp_replace(html, '{_q(D_REMOVED)}', '', 'g') AS h FROM {src}),
{name}f AS (SELECT page_id, url, html, CASE
        WHEN regexp_extract(h, '{_q(D_ARTICLE)}', 0) <> '' THEN regexp_extract(h, '{_q(D_ARTICLE)}', 0)
        WHEN regexp_extract(h, '{_q(D_MAIN)}', 0) <> '' THEN regexp_extract(h, '{_q(D_MAIN)}', 0)
        ELSE h END AS focus FROM {name}0),
{name} AS (SELECT page_id, url, html, {text} AS text FROM {name}f)"""


def h1_main_text(spark, sf):
    p = T(spark, sf, "pages").select("page_id", P.main_text("html").alias("text"))
    return p.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


H1_SQL = f"""WITH {d_main_text_ctes()}
SELECT page_id, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM mt"""


def _variant(page_id, url):
    """A page built around an id and an address with what real pages do: quoting, wrappers, deep nesting, entities."""
    six = lambda x: F.concat(F.lit("<div>" * 6), x, F.lit("</div>" * 6))
    side = F.concat(F.lit("<header class='top sidebar'>side"), six(F.lit("deep side")), F.lit("</header>"))
    wrapped = F.concat(F.lit('<div class="main-content-wrapper"><div id=m class=main-content>'), six(url),
                       F.lit('<p class="no-sidebar">kept &#8217; &eacute;&amp;lt; </p><div class="advertisements"><div>ad</div> ad</div></div>out</div>'))
    whole = F.concat(F.lit('<p title="a > b" class="my-sidebar">'), url, F.lit("</p><NAV><nav>in</nav>menu</NAV> &#x20AC; "), page_id)
    return F.concat(F.lit("<body>"), side, F.when(page_id % 2 == 0, wrapped).otherwise(whole), F.lit("</body>"))


def h1_variants(spark, sf):
    p = T(spark, sf, "pages")
    return p.select("page_id", P.main_text(_variant(F.col("page_id"), F.col("url"))).alias("text"))


#: written out from the variant's parts, not read back from its tags
H1_VARIANTS_SQL = """SELECT page_id, replace(CASE WHEN page_id % 2 = 0 THEN url || 'kept ’ é&lt;'
  ELSE url || '€ ' || page_id END, '&amp;', '&') AS text FROM pages"""


def _url_inputs(spark, sf):
    p = T(spark, sf, "pages")
    lst = F.concat(F.lit('{"Url_1": "no-scheme/'), F.col("page_id").cast("string"), F.lit('", "Url_2": "'),
                   F.col("url"), F.lit('?missing", "Url_3": "'), F.col("url"), F.lit('"}'))
    one = F.concat(F.lit('"'), F.col("url"), F.lit('"'))
    wrapped = F.concat(F.lit("['"), F.col("url"), F.lit("']"))
    bad = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    vs = F.array(*[F.struct(F.lit(i).alias("v"), c.alias("q")) for i, c in enumerate((lst, one, wrapped, bad))])
    return p.select("page_id", F.inline(vs)).select((F.col("page_id") * 10 + F.col("v")).alias("row_id"), "q")


def h2_first_page(spark, sf):
    got = P.first_page(_url_inputs(spark, sf), "q", T(spark, sf, "pages"))
    return got.select("row_id", F.md5("result").alias("result_md5"))


H2_SQL = f"""WITH {d_main_text_ctes()},
inp AS (
  SELECT page_id * 10 AS row_id, '{{"Url_1": "no-scheme/' || page_id || '", "Url_2": "' || url || '?missing", "Url_3": "' || url || '"}}' AS q FROM pages
  UNION ALL SELECT page_id * 10 + 1, '"' || url || '"' FROM pages
  UNION ALL SELECT page_id * 10 + 2, url FROM pages
  UNION ALL SELECT page_id * 10 + 3, 'page ' || page_id FROM pages),
j AS (SELECT row_id, q, CASE WHEN coalesce(json_valid(q), false) THEN json_type(q) = 'OBJECT' ELSE false END AS isj
      FROM inp),
cand AS (
  SELECT row_id, isj, i AS pos, json_extract_string(q, '$.' || json_keys(q)[i]) AS url
  FROM (SELECT *, unnest(generate_series(1, len(json_keys(q)))) AS i FROM j WHERE isj)
  UNION ALL SELECT row_id, isj, 0, replace(q, '"', '') FROM j WHERE NOT isj),
hits AS (SELECT c.row_id, c.isj, c.pos, coalesce(m.text, '{_q(P.NETWORK_MSG)}') AS text
         FROM cand c LEFT JOIN mt m USING (url) WHERE regexp_matches(c.url, '{URL_PATTERN}')),
best AS (SELECT row_id, arg_min(text, pos) AS best FROM hits
         WHERE NOT isj OR (text <> '' AND NOT starts_with(text, 'Error:')) GROUP BY row_id)
SELECT j.row_id, md5(coalesce(b.best, CASE WHEN j.isj THEN '{_q(P.NO_PAGE_MSG)}' ELSE '{_q(P.INVALID_URL_MSG)}' END))
       AS result_md5
FROM j LEFT JOIN best b USING (row_id)"""


def _hits(spark, sf):
    qs = T(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return P.search_pages(qs, T(spark, sf, "pages"))


def h3_search_pages(spark, sf):
    return _hits(spark, sf).select("qid", F.col("rank").cast("bigint").alias("rank"), "page_id", "score")


def _d_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 0)"


D_BM25 = f"""{d_main_text_ctes(limit=None)},
toks AS (SELECT page_id, unnest({_d_words('text')}) AS tok FROM mt),
tf AS (SELECT page_id, tok, count(*) AS tf FROM toks GROUP BY ALL),
dl AS (SELECT page_id, count(*) AS dl FROM toks GROUP BY page_id),
post AS (SELECT * FROM tf JOIN dl USING (page_id)),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf AS (SELECT tok, ln(1 + ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY tok),
qt AS (SELECT DISTINCT item_id AS qid, unnest({_d_words('text')}) AS tok FROM benchmark),
sc AS (SELECT qid, page_id, round(sum(idf * tf * {P.BM25_K1 + 1} / (tf + {P.BM25_K1} * (1 - {P.BM25_B} + {P.BM25_B} * dl /
          (SELECT avgdl FROM stats)))), 6) AS score
       FROM qt JOIN idf USING (tok) JOIN post USING (tok) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, page_id) AS rank FROM sc QUALIFY rank <= 5)"""

H3_SQL = f"""WITH {D_BM25}
SELECT qid, rank::BIGINT AS rank, page_id, score FROM top"""


def h4_format_notes(spark, sf):
    n = P.format_notes(_hits(spark, sf))
    return n.select("qid", F.md5("notes").alias("notes_md5"))


H4_SQL = f"""WITH {D_BM25},
meta AS (SELECT page_id, url, {d_text_of("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")} AS title,
                text AS body FROM mt)
SELECT qid, md5(string_agg('Note' || rank || ': ' || title || chr(10) || body || chr(10) || url || chr(10), ''
                ORDER BY rank)) AS notes_md5
FROM top JOIN meta USING (page_id) GROUP BY qid"""

def _note_reader():
    """A stand-in model: the address in the first note as JSON, else the first eight words."""
    import json
    import re

    def complete(prompts, **options):
        found = [re.search(r"\n(https?://\S+)\n(?=Note2:|\Z)", p) if p.startswith("Note1:") else None for p in prompts]
        return [json.dumps({"Url_1": m[1]}) if m else " ".join(p.split(" ")[:8]) for m, p in zip(found, prompts)]

    return complete


def g2_chain_search_fetch(spark, sf):
    """Complete, search with the completion, pick an address by the model, fetch the page: for every benchmark text."""
    prompts = T(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), F.lit("u").alias("user_id"),
                                               F.col("item_id").cast("string").alias("session_id"), F.col("text").alias("prompt"))
    ctx = G.ChainContext(spark, completer_factory=_note_reader, context_size=10_000_000, user_tag="", assistant_tag="",
                         pages=T(spark, sf, "pages"))
    steps = [("{full_prompt}", "llm_completion", "{}", "next"), ("{result}", "internet_search", "", "next"),
             ("{result}", "llm_completion", "{}", "next"), ("{result}", "getwebpage", "", "next")]
    return G.run_chain(prompts, steps, ctx).select("row_id", F.md5("result").alias("result_md5"))


_D_EIGHT = D_BM25.replace("FROM benchmark)", "FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS text FROM benchmark))")
G2_FETCH_SQL = f"""WITH {_D_EIGHT}
SELECT item_id AS row_id, md5(coalesce(substr(mt.text, 1, {P.WEB_TEXT_CHARS}), '{_q(P.INVALID_URL_MSG)}')) AS result_md5
FROM benchmark LEFT JOIN (SELECT * FROM top WHERE rank = 1) t ON t.qid = item_id LEFT JOIN mt USING (page_id)"""

QUERIES = {
    "G2_chain_search_fetch": (g2_chain_search_fetch, G2_FETCH_SQL),
    "H1_main_text": (h1_main_text, H1_SQL),
    "H1_variants": (h1_variants, H1_VARIANTS_SQL),
    "H2_first_page": (h2_first_page, H2_SQL),
    "H3_search_pages": (h3_search_pages, H3_SQL),
    "H4_format_notes": (h4_format_notes, H4_SQL),
}
