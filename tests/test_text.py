from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.template import render


def one(spark, col, value, ddl="s string"):
    return spark.createDataFrame([(value,)], ddl).select(col.alias("o")).first()["o"]


def test_valid_json_rules(spark):
    cases = {'{"k": 9}': True, '{"k": 9}\n': True, " 7 ": True, "null": True, "": False, None: False,
             '"k": 69}': False, "1 2": False, '{"a":1}], [{"b":2}': False, "NaN": False}
    for text, want in cases.items():
        assert one(spark, X.is_valid_json("s"), text) is want, text


def test_valid_url(spark):
    assert one(spark, X.is_valid_url("s"), "http://example.com/a") is True
    assert one(spark, X.is_valid_url("s"), "http:///path") is False      # URL without host
    assert one(spark, X.is_valid_url("s"), "example.com/a") is False
    assert one(spark, X.is_valid_url("s"), None) is False


def test_unwrap_and_strip(spark):
    assert one(spark, X.unwrap("s"), '{"df": "SELECT 1"}') == "SELECT 1"
    assert one(spark, X.unwrap("s"), '{"other": 1}') == ""
    assert one(spark, X.unwrap("s"), "  SELECT 2 \n") == "SELECT 2"
    assert one(spark, X.strip_list("s"), "['abc']") == "abc"
    assert one(spark, X.strip_list("s"), "abc") == "abc"
    assert one(spark, X.strip_list("s", guarded=False), "ab") == ""


def test_suffix_truncate_cut_as_text(spark):
    assert one(spark, X.remove_suffix("s"), "done[stop]") == "done"
    assert one(spark, X.remove_suffix("s"), "done") == X.NO_STOP_MSG
    assert one(spark, X.truncate("s", 3), "abcdef") == "abc" + X.TRUNCATE_MARKER
    assert one(spark, X.cut_completion("s", max_tokens=2), "a b c [User]: d") == "a b"
    assert one(spark, X.as_text("s"), None) == "None"


def test_budget_gate(spark):
    long = "x" * 4000
    assert one(spark, X.budget_gate("s", 1024, 128), long) == X.TOO_LONG_MSG
    assert one(spark, X.budget_gate("s", 4096, 128), long) == long


def test_render_does_not_reexpand(spark):
    df = spark.createDataFrame([("say {result}", None)], "p string, r string")
    out = df.select(render("  {{x}} {full_prompt} / {result}  ", full_prompt=F.col("p"), result=F.col("r"))).first()[0]
    assert out == "{x} say {result} / None"


def test_sentences(spark):
    df = spark.createDataFrame([("A b. C d!  E?\nF", ), ("", ), (None, )], "t string")
    got = [r[0] for r in df.select(X.sentences("t")).collect()]
    assert got[0] == ["A b.", "C d!", "E?", "F"]
    assert got[1] == []


def test_sentences_are_trimmed_as_before(spark):
    ends = ["", " ", "\n", "\r\n", "\u0085", "\u2028", "\u2029", " \u2028", "\n\u0085", "\u2028 ", " \u2029\u2029", "\x0b\f", "\u00a0", "\x1f"]
    texts = [(None,), ("",)] + [(a + "One. Two!\tThree" + b,) for a in ends for b in ends] + [(a + b,) for a in ends for b in ends]
    df = spark.createDataFrame(texts, "s string").select("s", X.sentences("s").alias("got"),
                                                         F.array_remove(F.split(X.strip_ws("s"), X.SENTENCE_SPLIT), "").alias("want"))
    assert all(r.got == r.want for r in df.collect())
