import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import guided as G


def ok(spark, schema, texts, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(G.conforms("t", schema, **kw)).collect()]


PARCEL = {"type": "object", "properties": {"to": {"type": "string"}, "grams": {"type": "number"},
                                           "fragile": {"type": "boolean"}}, "required": ["to"]}


def test_members_in_name_order_with_one_space(spark):
    cases = {'{"fragile": true, "grams": 12.5, "to": "Oslo"}': True, '{"fragile":true,"grams":-3e2,"to":""} ': True,
             '{"to": "Oslo", "fragile": true, "grams": 12.5}': False, '{"fragile": true, "grams":  1, "to": "x"}': False,
             '{"fragile": true, "grams": 1, "to": "x"}\n': False, '{"fragile": true, "grams": 1}': False,
             '{"fragile": yes, "grams": 1, "to": "x"}': False}
    assert ok(spark, PARCEL, list(cases)) == list(cases.values())


def test_shipped_student_format_wants_name_order(spark):
    rx = G.named_regex("student")
    df = spark.createDataFrame([('{"age": 19, "isStudent": true, "name": "Ada"}',), ('{"name": "Ada", "age": 19, "isStudent": true}',)], "t string")
    assert [r[0] for r in df.select(G.conforms("t", regex=rx)).collect()] == [True, False]


def test_types_of_nodes():
    schema = {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "integer"}}, "a": {"enum": [1, "x"]},
                                               "c": {"anyOf": [{"type": "null"}, PARCEL]}, "d": PARCEL}}
    assert G.schema_ddl(schema) == ("struct<`a`: string, `b`: array<bigint>, `c`: struct<branch: int, value: variant>, "
                                    "`d`: struct<`fragile`: boolean, `grams`: double, `to`: string>>")
    assert G.schema_ddl(schema, {"d": 0}).startswith("struct<`d`")


def test_single_expression_and_prop_order(spark):
    s = {"type": "object", "properties": {"df": {"type": "string"}}}
    assert ok(spark, s, ['{"df": "SELECT \\"a\\" FROM t"}', '{"df": 1}']) == [True, False]
    two = {"type": "object", "properties": {"b": {"type": "integer"}, "a": {"type": "integer"}}}
    assert ok(spark, two, ['{"b": 1, "a": 2}'], prop_order={"b": 0, "a": 1}) == [True]


def test_composites(spark):
    s = {"type": "object", "properties": {
        "tags": {"type": "array", "items": {"type": "string"}},
        "kind": {"enum": ["x", "y"]}, "v": {"oneOf": [{"type": "integer"}, {"type": "null"}]},
        "c": {"const": 3}}}
    texts = ['{"c": 3, "kind": "x", "tags": [], "v": null}', '{"c": 3, "kind": "z", "tags": ["a"], "v": 1}']
    assert ok(spark, s, texts) == [True, False]


def test_long_strings_do_not_overflow(spark):
    big = json.dumps({"df": "ab\\n" * 200000})
    assert ok(spark, {"type": "object", "properties": {"df": {"type": "string"}}}, [big]) == [True]


def test_bad_schema():
    with pytest.raises(G.SchemaError):
        G.schema_regex("{not json")
    with pytest.raises(G.SchemaError):
        G.schema_regex({"type": "date"})


def test_parse_guided(spark):
    df = spark.createDataFrame([('{"k": 5}',), ('{"k": "5"}',)], "t string")
    got = [r["parsed"] for r in G.parse_guided(df, "t", {"type": "object", "properties": {"k": {"type": "integer"}}})
           .collect()]
    assert got[0]["k"] == 5 and got[1] is None


def test_named_formats(spark):
    cases = {
        "cars": ('{"age": 3, "courses": ["a", "b"], "is_student": true, "name": "x"}',
                 '{"age": 3, "courses": "a", "is_student": true, "name": "x"}'),
        "example1": ('{"age": 7, "is_active": false, "name": "n"}', '{"age": 7.5, "is_active": false, "name": "n"}'),
        "delivery": ('{ "tracking_number": "1", "status":"ok",\n "weight": "2kg", "submitted_ts": "t"}',
                     '{"tracking_number": "1", "status": "o\\"k", "weight": "2", "submitted_ts": "t"}'),
        "news": ('{"title":"t","subtitle":"s","author":"a","date":"d","content":"c","tags":[],"references":["r"]}',
                 '{"title":"t","subtitle":"s","author":"a","date":"d","content":"c","tags":[]}'),
    }
    rows = [(name, i, text) for name, pair in cases.items() for i, text in enumerate(pair)]
    df = spark.createDataFrame(rows, "fmt string, i int, t string")
    for name in cases:
        got = {r.i: r.ok for r in df.filter(df.fmt == name)
               .select("i", G.conforms("t", regex=G.named_regex(name)).alias("ok")).collect()}
        assert got == {0: True, 1: False}, name


CHOICE = {"oneOf": [{"type": "object", "properties": {"k": {"type": "integer"}, "t": {"type": "string"}}}, {"type": "integer"},
                    {"type": "number"}, {"type": "null"}, {"enum": ["on", 5.0]}]}


def test_alternatives_pick_their_branch(spark):
    texts = ['{"k": 3, "t": "a, \\"b\\""}', "7", "-2.50", "null", '"on"', "5.0", '"off"', '{"t": "x", "k": 3}', "", None, "7 ", '{"k":3,"t":"]"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = G.parse_guided(df, "t", CHOICE)
    p = F.col("parsed")
    got = out.select("i", p["branch"].alias("b"), G.alternative(p, CHOICE, 0).alias("o"), G.alternative(p, CHOICE, 1).alias("n"),
                     G.alternative(p, CHOICE, 2).alias("x"), G.alternative(p, CHOICE, 4).alias("e")).orderBy("i").collect()
    assert [r.b for r in got] == [0, 1, 2, 3, 4, 2, None, None, None, None, 1, 0]
    assert (got[0].o.k, got[0].o.t) == (3, 'a, "b"') and got[11].o.t == "]" and got[1].n == 7 and got[2].x == -2.5 and got[4].e == "on"
    assert got[1].x is None and got[3].o is None


def test_alternatives_inside_objects_and_lists(spark):
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": CHOICE}, "b": {"anyOf": [{"type": "boolean"}, {"type": "string"}]},
                                               "c": {"const": "fix"}, "z": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}}}
    texts = ['{"a": [1, 2.5,null, {"k": 1, "t": "x,]"}, "on"], "b": "true", "c": "fix", "z": [[1, 2],[]]}',
             '{"a": [], "b": true, "c": "fix", "z": []}', '{"a": [true], "b": true, "c": "fix", "z": []}', '{"a": [], "b": true, "c": "no", "z": []}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = G.parse_guided(df, "t", schema).select("i", F.transform("parsed.a", lambda x: x["branch"]).alias("a"), F.col("parsed.b.branch").alias("b"),
                                                 "parsed.c", "parsed.z", F.transform("parsed.a", lambda x: F.to_json(x["value"])).alias("v")).orderBy("i").collect()
    assert got[0].a == [1, 2, 3, 0, 4] and got[0].b == 1 and got[0].c == "fix" and got[0].z == [[1, 2], []]
    assert got[0].v[3] == '{"k":1,"t":"x,]"}'
    assert got[1].a == [] and got[1].b == 0 and got[2].a is None and got[3].c is None
