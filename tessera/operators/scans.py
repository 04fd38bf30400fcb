"""Running and framed values along an order, for keys of any size.

A window over a key puts all its rows into one task. Here the rows are dealt by ranges of (keys, order) first, so a key
with a third of all rows lies in many parts, one after another; a part is worked on alone, and what it needs of the
parts before it, one row for each part, is added afterwards:

- ``running``: the part's totals are summed over the earlier parts of the key (or the last value is carried on) and
  joined to its rows.
- ``framed``: the last ``n`` rows before a part come into it as a halo, so frames of ``n`` rows see what they would.
- ``asof``: each row's nearest earlier row of another table; every part passes its last such row on.

Rows of equal keys and order stay in one part; the order should tell rows apart, as a window's should.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import pinned

PART = "_part"


@dataclass(frozen=True)
class Parts:
    """Rows with the number of the part they lie in; numbers rise along (keys, order)."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    def inside(self):
        return Window.partitionBy(*self.keys, PART).orderBy(*self.order)

    def along(self):
        """Over the parts of a key, one row for each."""
        return Window.partitionBy(*self.keys).orderBy(PART)


def in_parts(df: DataFrame, keys, order, parts: int | None = None) -> Parts:
    """Deals ``df`` by ranges of (keys, order) and writes it once, so that both uses of it see the same parts."""
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys, *order)
    return Parts(pinned(ranged.withColumn(PART, F.spark_partition_id()), "parts"), tuple(keys), tuple(order))


def joined(rows: DataFrame, of_part: DataFrame, keys) -> DataFrame:
    """The values of its part for every row; equal keys meet, null with null."""
    named = {c: f"_key_{i}" for i, c in enumerate(keys)}
    side = of_part.select(*[F.col(c).alias(named.get(c, "_part_of" if c == PART else c)) for c in of_part.columns])
    same = F.col(PART) == F.col("_part_of")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(named[c]))
    return rows.join(side, same).drop("_part_of", *named.values())


def _text_total(c: Column, order: Column) -> Column:
    pieces = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(c, F.lit("")).alias("t"))))
    return F.array_join(F.transform(pieces, lambda s: s["t"]), "")


def _added(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


#: kind -> (value over a window, total of a part by order, totals over a window, total before and value inside together)
KINDS = {
    "sum": (F.sum, lambda c, o: F.sum(c), F.sum, _added),
    "count": (F.count, lambda c, o: F.count(c), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, lambda c, o: F.min(c), F.min, F.least),
    "max": (F.max, lambda c, o: F.max(c), F.max, F.greatest),
    # the last value that is not null; max_by passes over rows whose order is null here
    "last": (lambda c: F.last(c, True), lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)), lambda t: F.last(t, True),
             lambda a, b: F.coalesce(b, a)),
    # all texts joined; a null text is empty
    "text": (lambda c: F.array_join(F.collect_list(F.coalesce(c, F.lit(""))), ""), _text_total,
             lambda t: F.array_join(F.collect_list(t), ""), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))),
}


def _over(value, c: Column, window) -> Column:
    """``value(c)`` over the window; texts are collected over it and joined."""
    if value is KINDS["text"][0]:
        return F.array_join(F.collect_list(F.coalesce(c, F.lit(""))).over(window), "")
    if value is KINDS["text"][2]:
        return F.array_join(F.collect_list(c).over(window), "")
    return value(c).over(window)


def running(parts: Parts, values: dict[str, tuple[str, Column | str]], current: bool = True) -> DataFrame:
    """The rows with running values: name -> (``sum``, ``count``, ``min``, ``max``, ``last`` that is not null, or ``text``; column).

    Up to and with the row itself, or with ``current=False`` up to the one before it. See ``with_running`` for further scans.
    """
    return with_running(parts, values, current).rows.drop(PART)


def with_running(parts: Parts, values: dict[str, tuple[str, Column | str]], current: bool = True) -> Parts:
    """``running``, with the rows still in their parts."""
    inside = parts.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
    before = parts.along().rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct(*parts.order)
    given = [(i, name, KINDS[kind], F.col(c) if isinstance(c, str) else c) for i, (name, (kind, c)) in enumerate(values.items())]
    totals = parts.rows.groupBy(*parts.keys, PART).agg(*[k[1](c, order).alias(f"_total_{i}") for i, _, k, c in given])
    of_part = totals.select(*parts.keys, PART, *[_over(k[2], F.col(f"_total_{i}"), before).alias(f"_before_{i}") for i, _, k, _ in given])
    rows = parts.rows.select("*", *[_over(k[0], c, inside).alias(f"_in_{i}") for i, _, k, c in given])
    out = joined(rows, of_part, parts.keys)
    out = out.withColumns({name: k[3](F.col(f"_before_{i}"), F.col(f"_in_{i}")) for i, name, k, _ in given})
    return replace(parts, rows=out.drop(*[f"_{x}_{i}" for i, *_ in given for x in ("in", "before")]))


def framed(parts: Parts, n: int, values) -> DataFrame:
    """The rows with ``values(window)``, a dict of columns over windows that look back at most ``n`` rows.

    ``window`` is ordered inside a part; the halo, the last ``n`` rows of the key before the part, stands in front.
    """
    columns = parts.rows.columns
    latest = parts.inside().orderBy(*[F.col(c).desc() for c in parts.order])
    tail = parts.rows.withColumn("_nth", F.row_number().over(latest)).where(F.col("_nth") <= n)
    row = F.struct(*[c for c in columns if c not in (PART, *parts.keys)])
    tails = tail.groupBy(*parts.keys, PART).agg(F.sort_array(F.collect_list(F.struct((-F.col("_nth")).alias("at"), row.alias("row")))).alias("_tail"))
    # a part holds a row of the key at least, so the n parts before hold its last n rows
    halo = tails.withColumn("_tail", F.flatten(F.collect_list("_tail").over(parts.along().rowsBetween(-n, -1))))
    halo = halo.select(*parts.keys, PART, F.explode(F.slice("_tail", -F.least(F.lit(n), F.greatest(F.size("_tail"), F.lit(1))), n)).alias("_row"))
    halo = halo.select(*parts.keys, PART, "_row.row.*").select(*columns, F.lit(True).alias("_halo"))
    every = parts.rows.select(*columns, F.lit(False).alias("_halo")).unionByName(halo)
    return every.withColumns(values(parts.inside())).where(~F.col("_halo")).drop("_halo", PART)


def asof(left: DataFrame, right: DataFrame, keys, left_time: str, right_time: str, carry, equal: bool = False, ties=(),
         parts: int | None = None) -> DataFrame:
    """The left rows with ``carry`` of the nearest earlier right row of the key (with ``equal``, also one of the same time).

    Of right rows of one time the last by ``ties`` counts. A row whose time is null finds nothing and is not found; null
    keys match. Left rows without an earlier right row get nulls.
    """
    taken = {c.lower() for c in left.columns}
    if {c.lower() for c in carry} & taken:
        raise ValueError("carried columns have names of the left table")
    own = F.struct(*left.columns)
    found = F.struct(*[F.col(c) for c in carry])
    tie = [F.col(c) for c in ties]
    both = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_time"),
                       F.lit(1 if equal else 0).alias("_side"), own.alias("_left")).unionByName(
        right.where(F.col(right_time).isNotNull()).select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("_time"), F.lit(0 if equal else 1).alias("_side"),
            found.alias("_right"), *[t.alias(f"_tie{i}") for i, t in enumerate(tie)]), allowMissingColumns=True)
    cut = in_parts(both, [f"_k{i}" for i in range(len(keys))], ["_time", "_side", *[f"_tie{i}" for i in range(len(tie))]], parts)
    merged = running(cut, {"_found": ("last", "_right")}).where(F.col("_left").isNotNull())
    seen = F.when(F.col("_time").isNotNull(), F.col("_found"))
    return merged.withColumn("_found", seen).select("_left.*", *[F.col("_found")[c].alias(c) for c in carry])


def exact_quantiles(df: DataFrame, column: str, probabilities, gather: int = 10_000) -> list[float | None]:
    """The interpolated percentiles of a numeric column, as Spark's ``percentile`` gives them, without holding all values.

    Every rank is kept between two values. A round counts the rows below and inside the brackets and asks for approximate
    percentiles of the inside only, in one aggregate for all ranks; the new bracket is taken if the counts prove that the
    rank is in it, else a wider one is asked for. A bracket of one value, or of at most ``gather`` different rows, is read.
    Nulls do not count; NaN is the largest value.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    n, numbers, low, high = values.agg(F.count("*"), F.count(F.when(~F.isnan("x"), 1)), F.min(F.when(~F.isnan("x"), F.col("x"))),
                                       F.max(F.when(~F.isnan("x"), F.col("x")))).head()
    if not n:
        return [None] * len(probabilities)
    places = [p * (n - 1) for p in probabilities]
    ranks = sorted({int(x) for x in places} | {min(int(x) + 1, n - 1) for x in places})
    known = {r: float("nan") for r in ranks if r >= numbers}
    # rank -> (low, high, rows below low, rows inside, share of the inside on either side)
    open_ = {r: (low, high, 0, numbers, 1e-3) for r in ranks if r < numbers}
    x = F.col("x")
    while open_:
        for r, (low, high, below, inside, _) in list(open_.items()):
            if low == high:
                known[r] = low
            elif inside <= gather:
                rows = values.where(x.between(low, high)).groupBy("x").count().orderBy("x").collect()   # at most ``gather`` rows
                at = below
                for value, many in rows:
                    at += many
                    if r < at:
                        known[r] = value
                        break
            if r in known:
                del open_[r]
        if not open_:
            break
        asked = {r: [max(0.0, (r - below) / inside - share), min(1.0, (r - below) / inside + share)]
                 for r, (_, _, below, inside, share) in open_.items()}
        near = values.agg(*[F.percentile_approx(F.when(x.between(open_[r][0], open_[r][1]), x), qs, 10_000).alias(str(r))
                            for r, qs in asked.items()]).head()
        tried = {r: tuple(near[str(r)]) for r in open_}
        counts = values.agg(*[e for r, (a, b) in tried.items()
                              for e in (F.count(F.when(x < a, 1)).alias(f"below_{r}"), F.count(F.when(x.between(a, b), 1)).alias(f"in_{r}"))]).head()
        for r, (a, b) in tried.items():
            below, inside = counts[f"below_{r}"], counts[f"in_{r}"]
            low, high, was_below, was_inside, share = open_[r]
            if below <= r < below + inside:
                open_[r] = (a, b, below, inside, share)
            else:
                open_[r] = (low, high, was_below, was_inside, min(1.0, share * 4))

    def between(place):
        first, last = int(place), min(int(place) + 1, n - 1)
        a, b = known[first], known[last]
        return a if first == place or a == b else (last - place) * a + (place - first) * b

    return [between(place) for place in places]
