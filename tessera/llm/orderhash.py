"""Near-duplicate documents by Order MinHash, verified by banded alignment.

1. Texts that are equal form a class, found by the first 128 bits of their SHA-256; only classes go on.
2. A sketch takes the ``PICK`` least of a text's five-word shingles, each labelled with its occurrence number, under one
   hash, and keeps their order in the text. ``SKETCHES`` of them per text. Texts of Jaccard similarity 0.8 in the same order
   share one sketch with probability about 0.5, and none of 20 with less than one in a million.
3. In every bucket (texts with one equal sketch) each member is compared with the bucket's most widely shared member.
   Where a bucket's members are then not all in one component, they are compared in tiles of at most about ``TILE`` texts
   a side, large buckets that overlap as one pool: every pair of a bucket is compared or connected already, and no list of
   a group's pairs is made. Only for a large group of texts that share sketches without being similar does that work grow
   with the square of its size, in bounded tasks.
4. A link needs a Jaccard similarity of the shingle sets of at least ``SIMILARITY`` and, by banded alignment, an edit
   similarity 1 - distance / longer length of at least as much (so texts in another order do not count).
5. Groups are the connected components of the links.

Words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased. A text of one to four words is one shingle; null texts count as empty; texts
without words match equal texts only. A null id is no least id while a copy has one; of classes, one without ids comes first
among those that may be kept. Rows with equal id and text are copies of one document, and one of them is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import free_name, pin, table
from tessera.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 20
PICK = 3
TILE = 128
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _word_keys(texts: pa.Array):
    for _, data, offsets in W.slices(texts):
        data = W.LOWER[data]
        starts, ends, rows = W.spans(data, offsets, W.NOT_SPACE)
        yield W.keys(data, starts, ends), rows, len(offsets) - 1


def _shingles(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle key, row) in text order; a text shorter than a shingle is one."""
    sizes = np.bincount(rows, minlength=n_rows)
    begins = np.cumsum(sizes) - sizes
    ends = begins + sizes
    at = np.arange(len(keys))
    start = (at + SHINGLE <= ends[rows]) | ((sizes[rows] < SHINGLE) & (at == begins[rows])) if len(keys) else np.zeros(0, bool)
    at = at[start]
    shingle = np.zeros(len(at), np.uint64)
    for d in range(SHINGLE):
        inside = at + d < ends[rows[at]]
        part = np.where(inside, keys[np.minimum(at + d, max(len(keys) - 1, 0))], np.uint64(0)) if len(at) else shingle
        shingle = W.mix(shingle * np.uint64(0x9E3779B97F4A7C15) + part)
    return shingle, rows[at]


def _occurrence(shingle: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many equal shingles of the same text come before each."""
    salted = shingle + W.mix(rows.astype(np.uint64) + np.uint64(1))
    order = np.argsort(salted, kind="stable")
    head = np.r_[True, salted[order][1:] != salted[order][:-1]] if len(order) else np.zeros(0, bool)
    place = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(head, place, 0))
    return out


def _sketch(texts: pa.Array, sketches: int, pick: int) -> pa.StructArray:
    counts, all_sketches = [], []
    for keys, rows, n in _word_keys(texts):
        shingle, owner = _shingles(keys, rows, n)
        sizes = np.bincount(owner, minlength=n)
        counts.append(sizes)
        result = np.zeros((n, sketches), np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            begins = (np.cumsum(sizes) - sizes)[full]
            spread = sizes[full]
            labelled = W.mix(shingle ^ W.mix(_occurrence(shingle, owner).astype(np.uint64)))
            for j in range(sketches):
                value = labelled * (W.mix(np.array([2 * j + 1], np.uint64)) | np.uint64(1))
                value ^= value >> np.uint64(29)
                value *= np.uint64(0xBF58476D1CE4E5B9)
                value ^= value >> np.uint64(32)
                chosen = []
                for _ in range(pick):
                    least = np.minimum.reduceat(value, begins)
                    at = np.flatnonzero((value == np.repeat(least, spread)) & (value != _TOP))
                    at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]] if len(at) else at
                    place = np.full(n, len(shingle), np.int64)        # texts with fewer shingles have fewer picks
                    place[owner[at]] = at
                    chosen.append(place[full])
                    value[at] = _TOP
                sketch = np.full(len(full), np.uint64(j + 1))
                padded = np.r_[shingle, np.uint64(0)]
                for place in np.sort(np.stack(chosen), axis=0):       # in text order
                    sketch = W.mix(sketch * np.uint64(0x9E3779B97F4A7C15) + padded[place])
                result[full, j] = sketch
        all_sketches.append((result, sizes > 0))
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    values = [r[f].astype(np.int64).ravel() for r, f in all_sketches]
    values = np.concatenate(values) if values else np.zeros(0, np.int64)
    offsets = np.r_[0, np.cumsum(np.where(sizes > 0, sketches, 0))].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists], ["n", "sketches"])


def order_min_hash(text: Column, sketches: int = SKETCHES, pick: int = PICK) -> Column:
    """struct(n: number of shingles, sketches: one 64-bit value for each, none for a text without words)."""
    @F.arrow_udf("struct<n:bigint,sketches:array<bigint>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _sketch(texts, sketches, pick)

    return sketch.asNondeterministic()(text)


def _packed_words(text: Column) -> Column:
    """The words of each text as 32-bit numbers."""
    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for keys, rows, n in _word_keys(texts):
                cuts = np.cumsum(np.bincount(rows, minlength=n))[:-1]
                out += [x.tobytes() for x in np.split((keys >> np.uint64(32)).astype(np.uint32), cuts)]
            yield pa.array(out, pa.binary())

    return packed.asNondeterministic()(text)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint32).astype(np.int64)


def _shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(_shingles(words.astype(np.uint64), np.zeros(len(words), np.int64), 1)[0])


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> np.ndarray:
    """Word edit distance of each pair, or a number over its limit; bands are widened only for pairs that need it."""
    out = np.full(len(pairs), -1, np.int64)
    cut = []
    for i, (x, y) in enumerate(pairs):                        # equal beginnings and ends cost nothing
        n = min(len(x), len(y))
        differs = np.flatnonzero(x[:n] != y[:n])
        head = int(differs[0]) if len(differs) else n
        x, y = x[head:], y[head:]
        n = min(len(x), len(y))
        differs = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
        tail = int(differs[0]) if len(differs) else n
        cut.append((x[:len(x) - tail], y[:len(y) - tail]))
        if not len(cut[-1][0]) or not len(cut[-1][1]):
            out[i] = len(cut[-1][0]) + len(cut[-1][1])
    band = 8
    open_ = [i for i in range(len(pairs)) if out[i] < 0]
    while open_:
        open_.sort(key=lambda i: len(cut[i][0]))
        again = []
        for k in range(0, len(open_), 128):
            part = open_[k:k + 128]
            for i, d in zip(part, _banded([cut[i] for i in part], band)):
                if d <= band or band >= limits[i]:
                    out[i] = d
                else:
                    again.append(i)
        open_, band = again, band * 4
    return out


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> list[int]:
    """Alignment of all pairs at once, row by row, over the diagonals -band..band; over the band: a number above it."""
    n = np.array([len(x) for x, _ in pairs])
    m = np.array([len(y) for _, y in pairs])
    wide, far = 2 * band + 1, 1 << 29
    x = np.full((len(pairs), n.max()), -1, np.int64)
    y = np.full((len(pairs), max(n.max(), m.max()) + wide + 1), -2, np.int64)
    for i, (a, b) in enumerate(pairs):
        x[i, :len(a)] = a
        y[i, band:band + len(b)] = b
    shift = np.arange(wide)
    cost = np.where(shift >= band, shift - band, far)[None, :].repeat(len(pairs), 0)
    result = [band + 1] * len(pairs)
    for row in range(1, n.max() + 1):
        step = cost + (y[:, row - 1:row - 1 + wide] != x[:, row - 1:row])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        if row <= band:
            step[:, :band - row] = far
            step[:, band - row] = row
        cost = np.minimum.accumulate(step - shift, axis=1) + shift
        for i in np.flatnonzero(n == row):
            if abs(m[i] - n[i]) <= band:
                result[i] = int(min(cost[i, m[i] - n[i] + band], far))
    return result


def _similar(pairs: list[tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Which pairs are aligned well enough."""
    longer = np.array([max(len(x), len(y)) for x, y in pairs], np.int64)
    limits = np.floor((1 - least) * longer + 1e-9).astype(np.int64)
    return edit_distances(pairs, limits.tolist()) <= limits


def _verified(least: float):
    @F.arrow_udf("boolean")
    def verified(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            pairs = [(_unpack(x), _unpack(y)) for x, y in zip(left.to_pylist(), right.to_pylist())]
            same = np.zeros(len(pairs), bool)
            for i, (x, y) in enumerate(pairs):
                s, t = _shingle_set(x), _shingle_set(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                same[i] = both >= least * (len(s) + len(t) - both) - 1e-9
            good = np.flatnonzero(same)
            same[good] = _similar([pairs[i] for i in good], least)
            yield pa.array(same)

    return verified.asNondeterministic()


def _tile_links(least: float):
    def links(group: pa.Table) -> pa.Table:
        """Links that join components of the members of two tiles (or of one tile with itself)."""
        nodes, packed = group["node"].to_pylist(), group["words"].to_pylist()
        side = group["side"].to_numpy()
        label = {c: i for i, c in enumerate(dict.fromkeys(group["label"].to_pylist()))}
        parent = list(range(len(label)))
        component = [label[c] for c in group["label"].to_pylist()]

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        sets = [_shingle_set(_unpack(p)) for p in packed]
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        for first in range(0, int(ids[-1]) + 1, 8192):                   # a strip of the incidence matrix at a time
            low, high = np.searchsorted(ids, [first, first + 8192])
            strip = np.zeros((len(sets), 8192), np.float32)
            strip[owner[low:high], ids[low:high] - first] = 1
            both += strip @ strip.T
        near = both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-6
        near &= (side[:, None] != side[None, :]) | (side.max() == side.min())
        found = []
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            a, b = top(component[i]), top(component[j])
            if a != b and _similar([(_unpack(packed[i]), _unpack(packed[j]))], least)[0]:
                parent[a] = b
                found.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return links


def _node(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), 1, 32))


def _pools(members: DataFrame) -> DataFrame:
    """Large buckets that share members are one pool, so that a pair they share is compared once: pool, node, label, tiles."""
    first = members.groupBy("bucket").agg(F.min("node").alias("b"))
    found = components(members.select("bucket", F.col("node").alias("a")).join(first, "bucket").select("a", "b").distinct())
    pooled = pin(members.select("node", F.col("label").alias("own")).distinct().join(found, "node").select(
        F.hex("label").alias("pool"), "node", F.col("own").alias("label")), "pools")
    sizes = pooled.groupBy("pool").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    return pooled.join(sizes, "pool").select("pool", "node", "label", "tiles")


def near_duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                          sketches: int = SKETCHES) -> DataFrame:
    """One row per class of equal texts: node, text_class (its least id, null if no copy has one), n_copies, group_id (least id
    of the group), kept_node (the class that ``drop_near_duplicates`` keeps a row of)."""
    key = F.col(id_column)
    read = docs.select(key.alias("id"), _node(text).alias("node"), F.col(text).cast("string").alias("text"))
    classes = pin(read.select("id", "node", order_min_hash(F.col("text"), sketches).alias("s")).groupBy("node").agg(
        F.min("id").alias("text_class"), F.count("*").alias("n_copies"), F.first("s").alias("s")), "classes")

    rows = classes.select("node", F.explode("s.sketches").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    buckets = pin(rows.join(shared, "bucket"), "buckets")
    wanted = buckets.select("node").distinct().join(classes.select("node", F.col("text_class").alias("id")), "node")
    # the key has the id too, so that the copies of one text do not meet in one task
    texts = pin(read.join(wanted, (read["node"] == wanted["node"]) & read["id"].eqNullSafe(wanted["id"]), "left_semi")
                .select("node", _packed_words(F.col("text")).alias("words"))
                .dropDuplicates(["node"]), "words")

    reach = buckets.groupBy("node").agg(F.sum("members").alias("reach"))
    ranked = buckets.join(reach, "node")
    centre = ranked.groupBy("bucket").agg(F.max_by("node", F.struct("reach", "node")).alias("centre"))
    pairs = ranked.join(centre, "bucket").where("node <> centre").select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    left = texts.select(F.col("node").alias("a"), F.col("words").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("right"))
    links = pin(pairs.join(left, "a").join(right, "b").where(_verified(similarity)(F.col("left"), F.col("right")))
                .select("a", "b"), "near")
    found = components(links)

    members = buckets.join(found, "node", "left").select("bucket", "node", "members", F.coalesce("label", "node").alias("label"))
    # buckets that hold the same texts are looked at once; two members have met already
    open_ = members.groupBy("bucket").agg(
        F.first("members").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
    open_ = pin(open_.where("n > 2 and low <> high").groupBy("n", "sum", "xor").agg(F.min("bucket").alias("bucket"))
                .select("bucket", "n"), "open")
    tiled = members.join(open_.where(F.col("n") <= TILE), "bucket").select(
        F.col("bucket").cast("string").alias("pool"), "node", "label", F.lit(1).cast("bigint").alias("tiles"))
    if open_.where(F.col("n") > TILE).head(1):
        tiled = tiled.unionByName(_pools(members.join(open_.where(F.col("n") > TILE), "bucket")))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(2)), F.col("tiles"))) \
        .withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1L)"))).select(
        "pool", "node", "label", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"),
        (F.col("tile") > F.col("other")).cast("int").alias("side"))
    rest = tiled.join(texts, "node").groupBy("pool", "tile_a", "tile_b").applyInArrow(
        _tile_links(similarity), "a binary, b binary")
    rest = pin(rest, "near")
    if rest.head(1):
        found = components(links.unionByName(rest))
    grouped = classes.select("node", "text_class", "n_copies").join(found, "node", "left") \
        .withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("text_class").alias("group_id"), F.count("*").alias("n_texts"),
                                         F.min(F.struct("text_class", "node"))["node"].alias("kept_node"))
    return grouped.join(least, "label").select("node", "label", "text_class", "n_copies", "group_id", "n_texts", "kept_node")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the least id (of equal ids, the first class by digest)."""
    node, key, rows = (free_name(docs, x) for x in ("_node", "_id", "_rows"))
    kept = near_duplicate_groups(docs, id_column, text).groupBy("label").agg(
        F.min(F.struct("text_class", "node")).alias("k")).select(F.col("k.text_class").alias(key), F.col("k.node").alias(node))
    tagged = docs.withColumn(node, _node(text)).withColumn(key, F.col(id_column))
    repeated = tagged.groupBy(node, key).agg(F.count("*").alias(rows))
    same = [F.col(f"d.{node}") == F.col(f"k.{node}"), F.col(f"d.{key}").eqNullSafe(F.col(f"k.{key}"))]
    kept = kept.alias("d").join(repeated.alias("k"), same).select(f"d.{node}", f"d.{key}", f"k.{rows}")
    chosen = tagged.alias("d").join(kept.alias("k"), same).select("d.*", f"k.{rows}")
    once = chosen.where(F.col(rows) == 1)
    several = chosen.where(F.col(rows) > 1).dropDuplicates([node])        # rows with equal id and text
    return once.unionByName(several).select(*docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, text_class (least id of the equal texts), group_id (least id of the near-duplicate group), n_texts, and kept:
    true for the one row of the group that ``drop_near_duplicates`` keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pin(docs.select("doc_id", _node("text").alias("node"), F.monotonically_increasing_id().alias("row")), "rows")
    grouped = rows.join(near_duplicate_groups(docs), "node")
    may = (F.col("node") == F.col("kept_node")) & F.col("doc_id").eqNullSafe(F.col("text_class"))
    first = grouped.where(may).groupBy("label").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    return grouped.join(first, "row", "left").select("doc_id", "text_class", "group_id", "n_texts", F.coalesce("first", F.lit(False)).alias("kept"))
