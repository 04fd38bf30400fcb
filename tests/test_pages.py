from tessera.operators import pages as P


def text(spark, html):
    return spark.createDataFrame([(html,)], "h string").select(P.main_text("h")).first()[0]




def test_main_text_paths(spark):
    page = ("<html><head><title>T</title><script>x()</script></head><body><nav>menu</nav>"
            "<div class=\"sidebar left\">side</div><article><h1> Head </h1><p>a &amp; b</p>\n<p> c </p></article>"
            "<footer>&copy; f</footer></body></html>")
    assert text(spark, page) == "Heada & bc"
    main = "<body><div class=\"advertisements\">ad</div><div class=\"main-content\"><p>m1</p> m2 </div><p>x</p></body>"
    assert text(spark, main) == "m1m2"
    whole = "<html><head><title>T &middot; t</title><style>p{}</style></head><body><!-- c --><p>w</p></body></html>"
    assert text(spark, whole) == "T · tw"
    assert text(spark, "<article>" + "z" * 8000 + "</article>") == "z" * 7500


def test_first_page_order_and_errors(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<article>A</article>"),
                                   (2, "http://b.example/y", "<article></article>")], "page_id long, url string, html string")
    q = spark.createDataFrame([
        (1, '{"u1": "nope", "u2": "http://missing.example/", "u3": "http://a.example/x"}'),  # first missing
        (2, '{"u1": "http://b.example/y"}'),                                                   # empty text skipped
        (3, '"http://a.example/x"'), (4, "['http://a.example/x']"), (5, "no url"),
        (6, "http://missing.example/")], "row_id long, q string")
    got = {r.row_id: r.result for r in P.first_page(q, "q", pages).collect()}
    assert got == {1: "A", 2: P.NO_PAGE_MSG, 3: "A", 4: "A", 5: P.INVALID_URL_MSG, 6: P.NETWORK_MSG}


def test_first_page_keeps_document_order(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<article>A</article>"),
                                   (2, "http://c.example/", "<article>C</article>")],
                                  "page_id long, url string, html string")
    q = spark.createDataFrame([(1, '{"z": "http://c.example/", "a": "http://a.example/x"}'),
                               (2, '{"a": "http://a.example/x", "z": "http://c.example/"}')], "row_id long, q string")
    got = {r.row_id: r.result for r in P.first_page(q, "q", pages).collect()}
    assert got == {1: "C", 2: "A"}


def test_nested_blocks(spark):
    page = ("<body><div class=\"sidebar\"><div><div>deep</div></div> side</div>"
            "<div class=\"main-content\"><div>one</div> two <div><p>three</p></div></div><div>x</div></body>")
    assert text(spark, page) == "onetwothree"
    nav = "<article><nav>a<nav>b</nav>c</nav>kept</article>"
    assert text(spark, nav) == "kept"


def test_what_real_pages_do(spark):
    cases = {
        '<p class="no-sidebar">kept</p>': "kept",
        '<div class="main-content-wrapper">a<div class="main-content">b</div></div>': "b",
        "<body><div class='sidebar'>x</div>kept</body>": "kept",
        '<header class="sidebar">x</header><p>kept</p>': "kept",
        "<p>it&#8217;s &eacute;t&#xE9; &nosuch; &amp;lt;</p>": "it’s été &nosuch; &lt;",
        "<div>out</div>" + "<div>" * 5 + '<div class="a main-content b">' + "<div>" * 5 + "in" + "</div>" * 5 + "</div>" + "</div>" * 5 + "<div>out2</div>": "in",
        '<div class="sidebar">' + "<div>" * 9 + "x" + "</div>" * 9 + "</div>kept": "kept",
        '<p title="a > b" class=sidebar>x</p>kept<br class="sidebar">too': "kepttoo",
        "<ARTICLE>a<NAV>x<nav>y</nav>z</NAV>b</ARTICLE>c": "ab",
        "kept<!-- <p>x</p> --><script>if (a < b) {}</script><footer>never closed <p>x</p>": "kept",
        "<article>one</article><article>two</article>": "one", "<article>": "", "": "", "1 < 2 > 0": "1 < 2 > 0",
    }
    df = spark.createDataFrame(list(cases.items()), "h string, want string")
    for r in df.select("h", "want", P.main_text("h").alias("got")).collect():
        assert r["got"] == r["want"], r["h"]


def test_long_pages_are_indexed_whole(spark):
    body = "filler " * 3000 + "needle"
    pages = spark.createDataFrame([(1, "http://a.example/", f"<p>{body}</p>"), (2, "http://b.example/", "<p>other</p>")],
                                  "page_id long, url string, html string")
    hits = P.search_pages(spark.createDataFrame([(7, "needle")], "qid int, query string"), pages).collect()
    assert [(h.page_id, h.body) for h in hits] == [(1, body)]


def test_page_index_statistics_per_document(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<article>x x x x</article>"),
                                   (2, "http://b.example/", "<article>a b</article>"),
                                   (3, "http://c.example/", "<article></article>")],
                                  "page_id long, url string, html string")
    idx = P.build_page_index(pages)
    assert idx.n == 2 and idx.avgdl == 3.0       # per document, not per posting row
