"""Scans in parts against windows over the whole key; as-of and quantiles against plain versions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import scans as S


def hot_rows(spark, n=900):
    """A third of all rows have one key; some keys, values and texts are null."""
    r = random.Random(3)
    rows = [("hot" if i % 3 == 0 else r.choice(["a", "b", None, "once" if i == 1 else "c"]), i, r.choice([None, r.randint(-50, 50)]),
             r.choice([None, "", "x", "yz"])) for i in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at int, v int, t string")


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


@pytest.mark.parametrize("current", [True, False])
def test_running_values_equal_those_of_windows(spark, current):
    df = hot_rows(spark)
    parts = S.in_parts(df, ["k"], ["at"], 13)
    hot = parts.rows.where("k = 'hot'").select(S.PART).distinct().count()
    assert hot >= 4                                              # the hot key is many tasks' work
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    want = df.withColumns({"s": F.sum("v").over(w), "n": F.count("v").over(w), "rows": F.count(F.lit(1)).over(w), "lo": F.min("v").over(w),
                           "hi": F.max("v").over(w), "seen": F.last("v", True).over(w),
                           "text": F.array_join(F.collect_list(F.coalesce("t", F.lit(""))).over(w), "")})
    got = S.running(parts, {"s": ("sum", "v"), "n": ("count", "v"), "rows": ("count", F.lit(1)), "lo": ("min", "v"), "hi": ("max", "v"),
                            "seen": ("last", "v"), "text": ("text", "t")}, current)
    same(want, got)


@pytest.mark.parametrize("parts, n", [(13, 2), (200, 5), (1, 3)])
def test_frames_that_cross_parts(spark, parts, n):
    df = hot_rows(spark, 300)
    over = lambda w: {"prev": F.lag("v", n).over(w), "mean": F.avg("v").over(w.rowsBetween(-n, 0)), "first": F.first("t").over(w.rowsBetween(-n, -1))}
    want = df.withColumns(over(Window.partitionBy("k").orderBy("at")))
    same(want, S.framed(S.in_parts(df, ["k"], ["at"], parts), n, over))


@pytest.mark.parametrize("equal", [True, False])
def test_asof_with_ties_and_empty_parts(spark, equal):
    r = random.Random(5)
    left = [(i, r.choice(["hot", "hot", "x", None, "none"]), r.choice([None, r.randint(0, 60)])) for i in range(300)]
    right = [(i, r.choice(["hot", "x", None]), r.choice([None, r.randint(0, 8), r.randint(50, 60)])) for i in range(60)]
    want = []
    for i, k, t in left:
        seen = [(u, j) for j, q, u in right if q == k and t is not None and u is not None and (u < t or equal and u == t)]
        want.append((i, max(seen)[1] if seen else None))
    a = spark.createDataFrame(left, "id int, k string, t int")
    b = spark.createDataFrame(right, "rid int, k string, u int")
    got = S.asof(a, b, ["k"], "t", "u", ["rid"], equal, ties=["rid"], parts=17)
    assert got.columns == ["id", "k", "t", "rid"] and sorted((r.id, r.rid) for r in got.collect()) == want
    nothing = S.asof(a, b.limit(0), ["k"], "t", "u", ["rid"], equal)
    assert nothing.where("rid is null").count() == 300
    assert S.asof(a.limit(0), b, ["k"], "t", "u", ["rid"], equal).count() == 0


PROBABILITIES = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one", "two", "empty", "nulls", "nan"])
def test_quantiles_equal_percentile(spark, kind):
    r = random.Random(7)
    values = {"normal": [r.gauss(0, 1) for _ in range(5000)], "ties": [float(r.choice([1, 1, 1, 2, 7])) for _ in range(4000)],
              "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(3000)], "one": [4.0], "two": [1.0, 2.0], "empty": [],
              "nulls": [None, 3.0, None, 1.0], "nan": [1.0, 2.0, float("nan"), 3.0, float("nan")]}[kind]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    want = df.select(F.percentile("x", F.array(*map(F.lit, PROBABILITIES)))).head()[0] or [None] * len(PROBABILITIES)
    got = S.exact_quantiles(df, "x", PROBABILITIES, gather=20)
    assert all(repr(a) == repr(b) or a == pytest.approx(b, rel=1e-12) for a, b in zip(got, want, strict=True)), (got, want)
