"""Property checks: native operators against plain statements of their rules."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions.text import sentences
from tessera.operators import library as L
from tessera.operators import memory as M

WORDS = st.text(alphabet="abcxyz ", min_size=1, max_size=40).map(lambda s: s.strip() or "w")
SENT = st.tuples(WORDS, st.sampled_from([".", "!", "?"])).map(lambda t: t[0] + t[1])
DOC = st.lists(SENT, min_size=0, max_size=12).map(" ".join)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(DOC, min_size=1, max_size=40), max_chars=st.integers(min_value=5, max_value=80))
def test_packed_chunks_are_full_and_complete(spark, docs, max_chars):
    """Chunks join to the sentences (a space after each), keep the limit unless a sentence alone breaks it, and none could
    have taken the sentence that the next one begins with."""
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string")
    for r in df.select(sentences("t").alias("s"), L.pack_chunks(sentences("t"), max_chars).alias("c")).collect():
        assert "".join(r.c) == "".join(f"{s} " for s in r.s)
        starts = {sum(len(s) + 1 for s in r.s[:k]): s for k, s in enumerate(r.s)}     # where each sentence begins
        at = 0
        for chunk, following in zip(r.c, [*r.c[1:], None]):
            held = [s for place, s in starts.items() if at <= place < at + len(chunk)]
            assert len(chunk) <= max_chars + 1 or len(held) == 1      # the last space is not counted
            at += len(chunk)
            if following is not None:
                assert len(chunk) + len(starts[at]) > max_chars
        assert bool(r.c) == bool(r.s)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sessions=st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=8),
                         min_size=1, max_size=6),
       budget=st.integers(min_value=1, max_value=40))
def test_sliding_memory_is_longest_fitting_suffix(spark, sessions, budget):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("u", f"s{si}", t0 + dt.timedelta(minutes=ti), "p" * a, "a" * b)
            for si, turns in enumerate(sessions) for ti, (a, b) in enumerate(turns)]
    df = spark.createDataFrame(rows, "user_id string, session_id string, ts timestamp, user_prompt string, "
                                     "llm_answer string")
    got = {(r.session_id, r.ts) for r in M.sliding_memory(df, budget).collect()}
    want = set()
    for si, turns in enumerate(sessions):
        total = 0
        for ti in range(len(turns) - 1, -1, -1):       # newest first
            total += turns[ti][0] + turns[ti][1] + 2
            if total / 3.5 > budget:
                break
            want.add((f"s{si}", t0 + dt.timedelta(minutes=ti)))
    assert got == want


from tessera.functions import guided as G  # noqa: E402

SCHEMA = {"type": "object", "properties": {
    "name": {"type": "string"}, "age": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}},
    "ok": {"type": "boolean"}, "score": {"type": "number"}}}
OBJ = st.fixed_dictionaries({
    "name": st.text(max_size=20), "age": st.integers(-10**6, 10**6),
    "tags": st.lists(st.text(max_size=8), max_size=4), "ok": st.booleans(),
    "score": st.floats(allow_nan=False, allow_infinity=False, width=32)})


def ordered(o):
    return {k: o[k] for k in sorted(o)}      # keys in name order, as the schema demands


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(objs=st.lists(OBJ, min_size=1, max_size=30))
def test_conforms_accepts_serialised_objects_and_rejects_mutations(spark, objs):
    import json

    texts, want = [], []
    for o in objs:
        o = ordered(o)
        texts += [json.dumps(o), json.dumps(o, separators=(",", ":")),
                  json.dumps(o).replace(": ", ":  ", 1),                    # two spaces after a colon
                  json.dumps({**o, "zz": 1}),                               # extra key
                  json.dumps({k: v for k, v in o.items() if k != "age"})]   # missing key
        want += [True, True, False, False, False]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.ok for r in df.select("i", G.conforms("t", SCHEMA).alias("ok")).collect()}
    assert [got[i] for i in range(len(texts))] == want


from tessera.functions.template import render  # noqa: E402

TEXT = st.text(alphabet="ab {}", max_size=12)
LIT = st.text(alphabet="xy ", max_size=6)
TEMPLATE = st.lists(st.one_of(LIT, st.sampled_from(["{full_prompt}", "{result}", "{{", "}}"])), max_size=6).map(
    "".join)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cases=st.lists(st.tuples(TEMPLATE, TEXT, st.one_of(st.none(), TEXT)), min_size=1, max_size=20))
def test_render_equals_str_format(spark, cases):
    from pyspark.sql import functions as F

    for i, (tpl, fp, res) in enumerate(cases):
        df = spark.createDataFrame([(fp, res)], "p string, r string")
        got = df.select(render(tpl, full_prompt=F.col("p"), result=F.col("r"))).first()[0]
        assert got == tpl.strip().format(full_prompt=fp, result=res), (tpl, fp, res)
