"""Near-duplicate embeddings by a subspace pigeonhole join.

Two unit vectors of cosine c are apart by the squared distance 2 - 2c. After one rotation the vectors are split into
blocks; in at least one block a linked pair keeps its share of the squared distance, so the pairs found by a range join
in each block, taken together, lose none. Every pair found is then compared exactly, in double precision.

A block's range join lays a grid over its first coordinates: a vector stands in its own cell and visits the cells
beyond it that its reach touches. A cell with its visitors is cut into tiles of ``TILE`` rows, which are compared two and
two, so a task's memory is bounded and rows carry a block's coordinates in 16 bits only (the range is widened by their
rounding).

Groups of copies are not expanded into pairs. Vectors are first sorted by label and by the signs of some rotated
coordinates, and in chunks of ``CHUNK`` rows the vectors within ``BALL`` of one of them (so near that all of them
link) become a ball. Balls are joined like single vectors, with ranges widened by their radii: two balls are linked as
wholes or not at all where the distance of their centres decides; else their members are compared, at most
``CHUNK`` with ``CHUNK`` in a task.

Defined results: a vector that is null, empty or zero, or holds null or non-finite entries, or has a null label, links
with nothing and is its own component; vectors of different lengths do not link. Rows are counted one by one, also
with equal ids; ``component_id`` is the least id that is not null, and null if there is none. Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pin, table
from tessera.llm.components import components

COSINE = 0.93
BLOCKS = 4
GRID = 3                 # coordinates of a block that the grid uses
BALL = 0.18              # radius; two vectors of a ball have a cosine of 1 - 2 * BALL ** 2 = 0.9352 at least
LEAST_BALL = 16
SIGNS = 8
CHUNK = 2048
TILE = 4096
SEED = 29
_STEP = 1 / 32000        # of a coordinate in 16 bits
_SLACK = 1e-6            # of distances in double precision


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation of d dimensions."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, d)).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


_ROTATIONS: dict[int, np.ndarray] = {}


def _rotated(units: np.ndarray) -> np.ndarray:
    d = units.shape[1]
    if d not in _ROTATIONS:
        _ROTATIONS[d] = rotation(d)
    return units @ _ROTATIONS[d]


def _blocks(d: int) -> list[tuple[int, int]]:
    """(first, end) of the blocks."""
    edges = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _unit_vectors(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of the usable vectors, by length."""
    if not len(vectors):
        return
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().cast(pa.float64())
    bad = values.is_null().to_numpy(zero_copy_only=False)
    values = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    wrong = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(values))])
    first = np.cumsum(sizes) - sizes
    good = (sizes > 0) & (wrong[first + sizes] == wrong[first])
    for size in np.unique(sizes[good]).tolist():
        at = np.flatnonzero(good & (sizes == size))
        rows = values[first[at][:, None] + np.arange(size)]
        largest = np.abs(rows).max(1)
        at, rows = at[largest > 0], rows[largest > 0]
        if len(at):
            rows = rows / np.abs(rows).max(1)[:, None]           # no square overflows or vanishes
            yield at, rows / np.linalg.norm(rows, axis=1)[:, None]


def _place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Length and signs of the first rotated coordinates; null where the vector is not usable."""
    for vectors in batches:
        length, signs = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int32)
        for at, units in _unit_vectors(vectors):
            length[at] = units.shape[1]
            some = _rotated(units)[:, :SIGNS] > 0
            signs[at] = some @ (1 << np.arange(some.shape[1]))
        yield pa.StructArray.from_arrays([pa.array(length), pa.array(signs)], names=["length", "signs"], mask=pa.array(length == 0))


def _balls(units: np.ndarray, ball: float) -> tuple[np.ndarray, np.ndarray]:
    """(centre of each row, or itself; distance from it). Centres are those with the most rows within ``ball`` not yet taken."""
    centre, away = np.arange(len(units)), np.zeros(len(units))
    if len(units) < LEAST_BALL:
        return centre, away
    cosine = units @ units.T
    near = cosine >= 1 - ball * ball / 2
    count, free = near.sum(1), np.ones(len(units), bool)
    while count.max() >= LEAST_BALL:
        most = int(count.argmax())
        taken = np.flatnonzero(near[most] & free)
        centre[taken] = most
        away[taken] = np.sqrt(np.maximum(2 - 2 * cosine[most, taken], 0)) + 1e-7
        away[most] = 0
        free[taken] = False
        count = count - near[:, taken].sum(1)
        count[~free] = 0
    return centre, away


def _members(rows: DataFrame, id_column: str, vector: str, label: str, ball: float, chunk: int) -> DataFrame:
    """One row per vector: number, id, its group (label and length; null: links with nothing), vector, unit (the number of its
    ball's centre, or its own), and on centres size and radius."""
    kind = rows.schema[vector].dataType.simpleString()
    placed = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                         F.col(vector).alias("vector"), F.arrow_udf(_place, "struct<length:int,signs:int>").asNondeterministic()(F.col(vector).cast("array<double>")).alias("place"))
    placed = placed.select(
        "id", F.when(F.col("place").isNotNull(), F.concat("label", F.lit("|"), F.col("place.length").cast("string"))).alias("group"),
        "vector", F.coalesce("place.signs", F.lit(0)).alias("signs"), F.xxhash64("vector").alias("hash"),
        F.monotonically_increasing_id().alias("read"))
    ordered = placed.repartitionByRange("group", "signs", "hash", "id", "read").sortWithinPartitions("group", "signs", "hash")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for b in batches:
            n = b.num_rows
            numbers = number + np.arange(n)
            number += n
            unit, size, radius = numbers.copy(), np.ones(n, np.int64), np.zeros(n)
            group, signs = b.column("group"), b.column("signs").to_numpy()
            known = group.is_valid().to_numpy(zero_copy_only=False)
            codes = group.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for at, units in _unit_vectors(b.column("vector")):
                at, units = at[known[at]], units[known[at]]
                new = np.flatnonzero(np.r_[True, (np.diff(codes[at]) != 0) | (np.diff(signs[at]) != 0), True]) if len(at) else []
                for i, j in zip(new[:-1], new[1:]):
                    for k in range(i, j, chunk):
                        part = at[k:min(k + chunk, j)]
                        centre, away = _balls(units[k:min(k + chunk, j)], ball)
                        unit[part] = numbers[part[centre]]
                        size[part] = np.bincount(centre, minlength=len(part))
                        farthest = np.zeros(len(part))
                        np.maximum.at(farthest, centre, away)
                        radius[part] = farthest
            mine = unit == numbers
            yield pa.record_batch([pa.array(numbers), b.column("id"), group, b.column("vector"), pa.array(unit),
                                   pa.array(size, mask=~mine), pa.array(radius, mask=~mine)],
                                  names=["number", "id", "group", "vector", "unit", "size", "radius"])

    return pin(ordered.mapInArrow(gather, f"number bigint, id bigint, group string, vector {kind}, unit bigint, size bigint, radius double"),
               "vectors")


def _share(first: int, end: int, d: int) -> float:
    return math.sqrt((end - first) / d)


def _cells(units: DataFrame, far: float, ball: float) -> DataFrame:
    """group, block, cell, home (or visitor), number, share (root of the block's part of all dimensions), radius, coordinates."""
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, radii = b.column("number").to_numpy(), b.column("radius").to_numpy()
            for at, units in _unit_vectors(b.column("vector")):
                turned, d = _rotated(units), units.shape[1]
                group = b.column("group").take(pa.array(at))
                for block, (first, end) in enumerate(_blocks(d)):
                    share = _share(first, end, d)
                    own = turned[:, first:end]
                    width = 2 * (far * share + _SLACK)
                    side = int(2 / width) + 3                    # cells along an axis, one more at either end
                    axes = min(GRID, end - first)
                    reach = np.where(radii[at] > 0, far + radii[at] + ball, far) * share + _SLACK
                    low = np.floor((own[:, :axes] - reach[:, None] + 1) / width).clip(-1, side - 2).astype(np.int64) + 1
                    high = np.floor((own[:, :axes] + reach[:, None] + 1) / width).clip(-1, side - 2).astype(np.int64) + 1
                    home = np.floor((own[:, :axes] + 1) / width).clip(-1, side - 2).astype(np.int64) + 1
                    powers = side ** np.arange(axes)
                    home = home @ powers
                    rows, cells = np.arange(len(at)), np.zeros(len(at), np.int64)
                    for k in range(axes):                        # all cells from low to high, axis by axis
                        many = high[rows, k] - low[rows, k] + 1
                        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                        rows, cells = np.repeat(rows, many), np.repeat(cells, many)
                        cells = cells + (low[rows, k] + step) * powers[k]
                    # a single vector visits only the cells beyond its own; the others' vectors visit it
                    kept = (cells >= home[rows]) | (radii[at][rows] > 0)
                    rows, cells = rows[kept], cells[kept]
                    short = np.round(own / _STEP).astype("<i2")
                    data = pa.Array.from_buffers(pa.binary(2 * (end - first)), len(at), [None, pa.py_buffer(short.tobytes())])
                    take = pa.array(rows)
                    yield pa.record_batch(
                        [group.take(take), pa.array(np.full(len(rows), block, np.int32)), pa.array(cells), pa.array(cells == home[rows]),
                         pa.array(numbers[at][rows]), pa.array(np.full(len(rows), share)), pa.array(radii[at][rows]),
                         data.cast(pa.binary()).take(take)],
                        names=["group", "block", "cell", "home", "number", "share", "radius", "data"])

    return units.select("group", "vector", "number", "radius").mapInArrow(
        lay, "group string, block int, cell bigint, home boolean, number bigint, share double, radius double, data binary")


def _candidates(cells: DataFrame, far: float, tile_rows: int) -> DataFrame:
    """(a, b), a < b: units that keep a block's share of the distance in some block."""
    key = ["group", "block", "cell"]
    sizes = cells.groupBy(*key).agg(F.count("*").alias("rows"), F.max(F.col("home").cast("int")).alias("homes")) \
        .where("homes = 1 and rows > 1").select(*key, F.ceil(F.col("rows") / tile_rows).cast("int").alias("tiles"))
    dealt = cells.join(sizes, key).withColumn("tile", F.pmod(F.xxhash64("number"), "tiles").cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))) \
        .select(*key, F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "tile",
                "home", "number", "share", "radius", "data")

    def compare(given: pa.Table) -> pa.Table:
        n = given.num_rows
        number, home = given["number"].to_numpy(), given["home"].to_numpy()
        radius, tile = given["radius"].to_numpy(), given["tile"].to_numpy()
        share = given["share"][0].as_py()
        points = np.frombuffer(b"".join(given["data"].to_pylist()), "<i2").reshape(n, -1).astype(float) * _STEP
        widened = _STEP * math.sqrt(points.shape[1]) + _SLACK    # rounding of both points
        within = given["one"][0].as_py() == given["two"][0].as_py()
        square = (points ** 2).sum(1)
        order = np.arange(n)
        found = [np.zeros((0, 2), np.int64)]
        for k in range(0, n, 512):
            rows = slice(k, k + 512)
            apart = square[rows, None] + square - 2 * (points[rows] @ points.T)
            limit = (far + radius[rows, None] + radius) * share + widened
            met = (apart <= limit * limit + 1e-9) & (home[rows, None] | home) & (order[rows, None] < order)
            if not within:
                met &= tile[rows, None] != tile
            i, j = np.nonzero(met)
            found.append(np.sort(np.stack([number[i + k], number[j]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy(*key, "one", "two").applyInArrow(compare, "a bigint, b bigint").where("a <> b").distinct()


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of two columns of usable vectors, equally long row by row."""
    made = np.zeros(len(a))
    for (at, x), (_, y) in zip(_unit_vectors(a), _unit_vectors(b)):
        made[at] = (x * y).sum(1)
    return made


def _verified(pairs: DataFrame, units: DataFrame, cosine: float, far: float) -> DataFrame:
    """The pairs that link, whole (all members with all) or not known yet: a, b, whole, size_a, size_b."""
    side = lambda x: units.select(F.col("number").alias(x), F.col("vector").alias(f"vector_{x}"), F.col("size").alias(f"size_{x}"),
                                  F.col("radius").alias(f"radius_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _cosines(b.column("vector_a"), b.column("vector_b"))
            apart = np.sqrt(np.maximum(2 - 2 * got, 0))
            width = b.column("radius_a").to_numpy() + b.column("radius_b").to_numpy()
            single = (b.column("size_a").to_numpy() == 1) & (b.column("size_b").to_numpy() == 1)
            whole = np.where(single, got >= cosine, apart + width <= far - _SLACK)
            open_ = ~single & ~whole & (apart - width <= far + _SLACK)
            kept = pa.array(np.flatnonzero(whole | open_))
            yield pa.record_batch([*[b.column(x).take(kept) for x in ("a", "b", "size_a", "size_b")], pa.array(whole).take(kept)],
                                  names=["a", "b", "size_a", "size_b", "whole"])

    return joined.mapInArrow(compare, "a bigint, b bigint, size_a bigint, size_b bigint, whole boolean")


def _between(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """a, b, number, n: the links of each member with the other ball of the pair."""
    own = members.select("unit", "number", "vector")
    sides = pairs.select("a", "b", F.col("a").alias("unit")).unionByName(pairs.select("a", "b", F.col("b").alias("unit"))).join(own, "unit")

    def compare(given: pa.Table) -> pa.Table:
        given = given.combine_chunks()
        number, first = given["number"].to_numpy(), given["unit"].to_numpy() == given["a"].to_numpy()
        (_, units), = _unit_vectors(given["vector"].chunk(0))
        linked = units[first] @ units[~first].T >= cosine
        n = np.zeros(len(number), np.int64)
        n[first], n[~first] = linked.sum(1), linked.sum(0)
        kept = np.flatnonzero(n)
        return pa.table({"a": given["a"].take(pa.array(kept)), "b": given["b"].take(pa.array(kept)), "number": number[kept], "n": n[kept]})

    return sides.groupBy("a", "b").applyInArrow(compare, "a bigint, b bigint, number bigint, n bigint")


def near_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                 ball: float | None = None, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. Vectors of equal labels with a cosine of at least ``cosine`` link."""
    far = math.sqrt(max(2 - 2 * cosine, 0.0))
    ball = min(BALL, 0.48 * far) if ball is None else min(ball, 0.48 * far)   # twice the radius is less than the distance of a link
    members = _members(rows, id_column, vector, label, ball, chunk)
    units = members.where(F.col("group").isNotNull() & (F.col("number") == F.col("unit")))
    pairs = pin(_verified(_candidates(pin(_cells(units, far, ball), "cells"), far, tile), units, cosine, far), "pairs")
    whole = pairs.where("whole")
    between = pin(_between(pairs.where("not whole"), members, cosine), "between")
    by_unit = whole.select(F.col("a").alias("unit"), F.col("size_b").alias("n")) \
        .unionByName(whole.select(F.col("b").alias("unit"), F.col("size_a").alias("n"))).groupBy("unit").agg(F.sum("n").alias("whole_links"))
    by_row = between.groupBy("number").agg(F.sum("n").alias("row_links"))
    links = whole.select("a", "b").unionByName(between.select("a", "b").distinct())
    nodes = components(links).withColumnRenamed("node", "unit")
    of_unit = members.groupBy("unit").agg(F.min("id").alias("least"), F.max("size").alias("size"))
    of_unit = of_unit.join(nodes, "unit", "left").withColumn("label", F.coalesce("label", "unit")).join(by_unit, "unit", "left")
    of_unit = pin(of_unit, "units")
    of_component = of_unit.groupBy("label").agg(F.min("least").alias("component_id"))
    known = of_unit.join(of_component, "label").select("unit", "component_id", (F.col("size") - 1 + F.coalesce("whole_links", F.lit(0))).alias("n"))
    return members.select("number", "id", "unit").join(known, "unit").join(by_row, "number", "left").select(
        F.col("id").alias(id_column), (F.col("n") + F.coalesce("row_links", F.lit(0))).alias("n_links"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
          WHERE list_cosine_similarity(x.v, y.v) >= {COSINE}),
reach AS (SELECT vec_id, vec_id AS r FROM e UNION SELECT reach.vec_id, b FROM reach JOIN links ON r = a),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counts ON vec_id = a
"""
