"""Web pages over a crawled ``pages(page_id, url, html)`` table.

Main text, first good page of a URL list, and ranked keyword search, all as
native expressions, joins and aggregations. HTML is read by one row-local fold
over a page's tags (``tessera.functions.html``): elements of any depth, exact
class tokens, all entities. Tags a parser would close implicitly are not modelled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.html import TAG, focus_nodes, joined_text
from tessera.functions.text import is_valid_json, is_valid_url, strip_ws
from tessera.session import pinned

# Fixed values that must equal the reference's for right results.
WEB_TEXT_CHARS = 7500
NO_PAGE_MSG = "Error: No valid URLs or unable to scrape any URLs"
INVALID_URL_MSG = "Error: Invalid URL"
NETWORK_MSG = "Error: Network problem (e.g., DNS failure, refused connection, etc)"
REMOVED_TAGS = ("nav", "footer")
REMOVED_CLASSES = ("sidebar", "advertisements")
MAIN_CLASS = "main-content"
SEARCH_K = 5


def main_text(html, limit: int | None = WEB_TEXT_CHARS) -> Column:
    """H1: main text of a page.

    Drop script/style/comments, ``nav``, ``footer`` and elements of class
    ``sidebar``/``advertisements``; take the first ``article``, else the first
    ``div.main-content``, else the whole page; strip each text node and join
    them; cut at ``limit`` characters (``None``: the whole text).
    """
    h = F.col(html) if isinstance(html, str) else html
    text = joined_text(focus_nodes(h, REMOVED_TAGS, REMOVED_CLASSES, "article", "div", MAIN_CLASS))
    return text if limit is None else F.substring(text, 1, limit)


def page_title(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return joined_text(F.split(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title>", 1), TAG))


def page_texts(pages: DataFrame) -> DataFrame:
    """``url, text`` of every crawled page (H1 applied)."""
    return pages.select("url", main_text("html").alias("text"))


# H2 ------------------------------------------------------------------------
def first_page(df: DataFrame, col: str, pages: DataFrame, key: str = "row_id", into: str = "result") -> DataFrame:
    """H2: text of the first good page named by ``col``.

    ``col`` holds a JSON object of URLs (tried in key order) or one URL (quotes
    removed, also when the text is a JSON string, where the reference fails);
    ``['...']`` wrapping is dropped first. Invalid URLs, pages not in
    the crawl and ``Error:`` texts are skipped. Candidates are joined to the
    crawl on ``url`` (only the pages asked for are parsed) and the first
    success per row is ``min_by(text, pos)``: partial aggregation, no window.
    """
    q = F.col(col)
    q = F.when(q.startswith("['") & q.endswith("']"), F.substring(q, F.lit(3), F.length(q) - 4)).otherwise(q)
    # only a JSON object is a URL list; a JSON string is one quoted URL
    base = df.withColumn("_q", q).withColumn("_json", is_valid_json("_q") & strip_ws("_q").startswith("{"))
    urls = F.when(F.col("_json"), F.from_json("_q", "map<string,string>")).otherwise(
        F.create_map(F.lit("url"), F.replace("_q", F.lit('"'), F.lit(""))))
    cand = base.select(key, "_json", F.posexplode_outer(urls).alias("_pos", "_k", "url"))
    cand = cand.filter(is_valid_url("url"))
    # parse only the pages that are asked for: the distinct candidate URLs are
    # joined to the crawl first (Catalyst does not move an expensive projection
    # above a join, so parsing the whole crawl first would cost every page)
    wanted = cand.select("url").distinct()
    texts = page_texts(pages.join(wanted, "url", "left_semi"))
    hits = cand.join(texts, "url", "left").withColumn(
        "text", F.coalesce(F.col("text"), F.lit(NETWORK_MSG)))
    # a single URL returns its page text or the fetch error as is
    good = hits.filter(~F.col("_json") | ((F.col("text") != "") & ~F.col("text").startswith("Error:")))
    best = good.groupBy(key).agg(F.min_by("text", "_pos").alias("_best"))
    out = base.join(best, key, "left")
    return out.withColumn(into, F.coalesce(
        F.col("_best"), F.when(F.col("_json"), F.lit(NO_PAGE_MSG)).otherwise(F.lit(INVALID_URL_MSG)))
    ).drop("_q", "_json", "_best")


# H3 ------------------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
WORD_SPLIT = r"[^\p{L}\p{N}]+"


def _words(c) -> Column:
    return F.array_remove(F.split(F.lower(c), WORD_SPLIT), "")


SEED_POSTINGS = 4000     # postings of a query's rarest words that give the first bound, about


@dataclass
class PageIndex:
    """A built page index: postings ``(page_id, tok, dl, tf)``, words ``(tok,
    df, top)`` with the largest term weight of each, and page rows ``(page_id,
    url, title, body)`` as tables, plus the two corpus statistics BM25 needs."""

    postings: DataFrame
    words: DataFrame
    meta: DataFrame
    n: int
    avgdl: float


def _term_weight(avgdl: float) -> Column:
    return F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.lit(avgdl)))


def build_page_index(pages: DataFrame, path: str | None = None) -> PageIndex:
    """Postings, words and page rows of a crawl, written once (under the shared
    checkpoint folder unless ``path`` is given) and reused by every search."""
    from tessera.session import scratch_path

    spark = pages.sparkSession
    path = path or scratch_path(spark, "page-index")
    # whole texts, written once to the shared folder: they feed the postings, and are the bodies of result rows
    (pages.select("page_id", "url", page_title("html").alias("title"), main_text("html", None).alias("body"))
     .write.parquet(f"{path}/meta"))
    docs = spark.read.parquet(f"{path}/meta")
    words = docs.select("page_id", _words("body").alias("w"))
    toks = words.select("page_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("tok"))
    # sorted by word inside the files, so that a search skips row groups of other words
    toks.groupBy("page_id", "tok", "dl").agg(F.count("*").alias("tf")).sortWithinPartitions("tok").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    # corpus statistics per document (a page is one row however many words it has);
    # the distinct is combined map-side, so about one row per page is shuffled
    per_page = postings.select("page_id", "dl").distinct()
    stats = per_page.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = int(stats["n"] or 0), float(stats["avgdl"] or 0.0)
    postings.groupBy("tok").agg(F.count("*").alias("df"), F.max(_term_weight(avgdl)).alias("top")).write.parquet(f"{path}/words")
    # bodies are read only for the few rows a search returns
    return PageIndex(postings, spark.read.parquet(f"{path}/words"), docs, n, avgdl)


def search_page_index(queries: DataFrame, index: PageIndex, qkey: str = "qid", qtext: str = "query",
                      k: int = SEARCH_K) -> DataFrame:
    """BM25 top-``k`` pages per query: ``qid, rank, page_id, url, title, body, score``.

    Exact, without scoring every page that shares a word with a query. The
    rarest words of a query give its k-th best partial score, a bound on the
    final one. Its most common words, as many as cannot reach that bound
    together, need not bring pages in: pages come from the other words, those
    that cannot reach the bound are dropped, and only the rest are looked up in
    the common words' postings. Ties go to the lower page id.
    """
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = queries.select(qkey, F.explode(F.array_distinct(_words(qtext))).alias("tok")).join(index.words, "tok")
    asked = asked.withColumn("idf", idf).withColumn("most", F.col("idf") * F.col("top")) \
        .withColumn("earlier", F.sum("df").over(Window.partitionBy(qkey).orderBy("df", "tok")) - F.col("df"))
    asked = pinned(asked.select(qkey, "tok", "idf", "most", "earlier"), "asked")
    weight = F.col("idf") * _term_weight(index.avgdl)

    def scored(words: DataFrame) -> DataFrame:
        return words.join(index.postings, "tok").groupBy(qkey, "page_id").agg(F.sum(weight).alias("s"))

    best = Window.partitionBy(qkey).orderBy(F.col("s").desc())
    seeds = scored(asked.filter(F.col("earlier") < SEED_POSTINGS)).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    bound = seeds.groupBy(qkey).agg(F.when(F.count("*") == k, F.min("s")).otherwise(F.lit(0.0)).alias("bound"))
    # the margin keeps pages whose rounded scores tie
    rising = Window.partitionBy(qkey).orderBy("most", "tok").rowsBetween(Window.unboundedPreceding, 0)
    split = asked.join(bound, qkey, "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - 2e-6) \
        .withColumn("common", F.sum("most").over(rising) < F.col("bound"))
    split = pinned(split, "split")
    rest = split.filter("common").groupBy(qkey).agg(F.sum("most").alias("rest"))
    limits = split.groupBy(qkey).agg(F.first("bound").alias("bound")).join(rest, qkey, "left").fillna(0.0, ["rest"])
    able = pinned(scored(split.filter(~F.col("common"))).join(limits, qkey).filter(F.col("s") + F.col("rest") >= F.col("bound"))
                  .select(qkey, "page_id", "s"), "candidates")
    late = able.select(qkey, "page_id").join(split.filter("common").select(qkey, "tok", "idf"), qkey) \
        .join(index.postings, ["tok", "page_id"]).select(qkey, "page_id", weight.alias("s"))
    per_page = able.unionByName(late).groupBy(qkey, "page_id").agg(F.round(F.sum("s"), 6).alias("score"))
    w = Window.partitionBy(qkey).orderBy(F.col("score").desc(), F.col("page_id"))
    top = per_page.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(index.meta, "page_id").select(qkey, "rank", "page_id", "url", "title", "body", "score")


def search_pages(queries: DataFrame, pages: DataFrame, qkey: str = "qid", qtext: str = "query",
                 k: int = SEARCH_K) -> DataFrame:
    """H3: build the page index and search it (build once, search many times
    with ``build_page_index`` + ``search_page_index``)."""
    return search_page_index(queries, build_page_index(pages), qkey, qtext, k)


# H4 ------------------------------------------------------------------------
def format_notes(hits: DataFrame, qkey: str = "qid", k: int = SEARCH_K) -> DataFrame:
    """H4: ``Note{i}: title\\nbody\\nhref\\n`` for the first ``k`` hits, in rank order."""
    note = F.concat(F.lit("Note"), F.col("rank").cast("string"), F.lit(": "), F.col("title"), F.lit("\n"),
                    F.col("body"), F.lit("\n"), F.col("url"), F.lit("\n"))
    return hits.filter(F.col("rank") <= k).groupBy(qkey).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", note.alias("t")))),
                                 lambda s: s["t"]), "").alias("notes"))
