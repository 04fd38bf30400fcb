"""Benchmark decontamination with suffix arrays over the training texts.

Every task sorts the word suffixes of its texts into suffix arrays, one per shard of a few megabytes, and searches every
suffix of the benchmark in each of them: the interval of equal suffixes is narrowed word by word, by binary search. The
interval left after a window's words holds all its occurrences; from there a match is followed to its full length. Texts
stay where they are read: no shuffle, and each text lies whole in one shard.

The benchmark reaches the tasks in blocks of at most ``BLOCK_BYTES`` of text (an item is never split): a larger benchmark
costs one pass over the documents for each block, never a larger broadcast.

Null and empty texts have no words; an item without words or a null item text has no window; a null item id counts as an
empty one; rows with equal item ids are one item. Repeated documents get equal results. Other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import free_name, pin, table
from tessera.llm.suffixes import doubling

WINDOW = 10
BLOCK_BYTES = 16 << 20
_STATE = ("struct<n_words:bigint,n_hit:bigint,spans:array<bigint>,items:array<string>,longest:bigint,longest_at:bigint,"
          "longest_item:string>")


def text_words(texts: pa.Array):
    """For each slice of texts: (word keys, row of each word, number of rows); A-Z are lower-cased."""
    for _, data, offsets in W.slices(texts):
        data = W.LOWER[data]
        starts, ends, rows = W.spans(data, offsets, W.ALNUM)
        yield W.keys(data, starts, ends), rows, len(offsets) - 1


class Block:
    """The windows of some benchmark items, ready to be searched for."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids = np.array(sorted(set(ids)), dtype=object)
        number = {x: i for i, x in enumerate(self.ids)}
        parts, owners, base = [], [], 0
        for words, rows, n in text_words(pa.array(texts, pa.large_string())):
            parts.append(words)
            owners.append(rows + base)
            base += n
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        sizes = np.bincount(owner, minlength=len(texts))
        ends = np.cumsum(sizes)[owner]
        at = np.arange(len(self.words))
        first = at == ends - sizes[owner]
        wide = np.where(sizes[owner] < window, sizes[owner], window)
        at = at[np.where(sizes[owner] < window, first, at + window <= ends)]
        wide = wide[at]
        key = W.mix(wide.astype(np.uint64))
        for d in range(window):                                   # equal windows are searched once
            more = wide > d
            key[more] = W.mix(key[more] ^ self.words[at[more] + d])
        key, self.at, group = np.unique(key, return_index=True, return_inverse=True)
        self.start, self.wide = at[self.at], wide[self.at]
        order = np.argsort(group, kind="stable")                  # places of window u: places[first[u]:first[u + 1]]
        self.places, self.ends = at[order], ends
        self.first = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(key)))]).astype(np.int64)
        self.item = np.array([number[x] for x in ids], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, running number within the owner) for each of ``counts`` elements."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _bound(symbols, ends, array, low, high, depth, wanted, right: bool) -> np.ndarray:
    """Binary search in each array interval [low, high) by the symbol at ``depth``; a suffix that has ended sorts first."""
    low, high = low.copy(), high.copy()
    while len(busy := np.flatnonzero(low < high)):
        middle = (low[busy] + high[busy]) // 2
        at = array[middle] + depth
        inside = at < ends[array[middle]]
        symbol = symbols[np.minimum(at, len(symbols) - 1)]
        less = ~inside | ((symbol <= wanted[busy]) if right else (symbol < wanted[busy]))
        low[busy] = np.where(less, middle + 1, low[busy])
        high[busy] = np.where(less, high[busy], middle)
    return low


def occurrences(symbols: np.ndarray, ends: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(position, window) of every occurrence of the block's windows in the shard."""
    none = np.zeros(0, np.int64)
    if not len(symbols) or not len(block.start):
        return none, none
    array, _ = doubling(symbols, ends, depth=int(block.wide.max()))
    ordered = symbols[array]
    live = np.arange(len(block.start))
    wanted = block.words[block.start]
    low, high = np.searchsorted(ordered, wanted, "left"), np.searchsorted(ordered, wanted, "right")
    found, depth = [], 0
    while True:
        keep = low < high
        live, low, high = live[keep], low[keep], high[keep]
        depth += 1
        done = block.wide[live] == depth
        owner, nth = _expand((high - low)[done])
        found.append((array[low[done][owner] + nth], live[done][owner]))
        live, low, high = live[~done], low[~done], high[~done]
        if not len(live):
            break
        wanted = block.words[block.start[live] + depth]
        low, high = (_bound(symbols, ends, array, low, high, depth, wanted, False),
                     _bound(symbols, ends, array, low, high, depth, wanted, True))
    return np.concatenate([p for p, _ in found]), np.concatenate([u for _, u in found])


def _match_lengths(symbols, ends, block, position, place) -> np.ndarray:
    """How many words the text at ``position`` and the benchmark at ``place`` have in common."""
    length = np.zeros(len(position), np.int64)
    live = np.arange(len(position))
    while len(live):
        p, t = position[live] + length[live], place[live] + length[live]
        same = (p < ends[position[live]]) & (t < block.ends[place[live]])
        live, p, t = live[same], p[same], t[same]
        live = live[symbols[p] == block.words[t]]
        length[live] += 1
    return length


def _search(texts: pa.Array, states: pa.Array | None, block: Block) -> pa.StructArray:
    """The state of each text after this block (see ``_STATE``); spans are start, end, start, end..."""
    before = states.to_pylist() if states is not None else None
    out, base = [], 0
    for symbols, rows, n in text_words(texts):
        sizes = np.bincount(rows, minlength=n)
        begins = np.cumsum(sizes) - sizes
        ends = np.cumsum(sizes)[rows] if len(rows) else rows
        position, window = occurrences(symbols, ends, block)
        change = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(change, position, 1)
        np.add.at(change, position + block.wide[window], -1)
        hit = np.cumsum(change[:-1]) > 0
        owner, nth = _expand((block.first[window + 1] - block.first[window]))
        place = block.places[block.first[window[owner]] + nth]
        where = position[owner]
        length = _match_lengths(symbols, ends, block, where, place)
        pair = np.unique(rows[where] * max(len(block.ids), 1) + block.item[place]) if len(where) else np.zeros(0, np.int64)
        results = [{"n_words": int(k), "n_hit": 0, "spans": [], "items": [], "longest": 0, "longest_at": None,
                    "longest_item": None} for k in sizes]
        for row, item in zip(pair // max(len(block.ids), 1), pair % max(len(block.ids), 1)):
            results[row]["items"].append(block.ids[item])
        order = np.lexsort((block.item[place], where, -length, rows[where]))
        firsts = order[np.r_[True, np.diff(rows[where][order]) != 0]] if len(order) else order
        for i in firsts:
            row = rows[where[i]]
            results[row] |= {"longest": int(length[i]), "longest_at": int(where[i] - begins[row]),
                             "longest_item": block.ids[block.item[place[i]]]}
        touched = np.unique(rows[where])
        for row in touched:
            h = np.r_[0, hit[begins[row]:begins[row] + sizes[row]].view(np.int8), 0]
            results[row]["spans"] = np.flatnonzero(np.diff(h)).tolist()
        if before is not None:
            for row in range(n):
                _join(results[row], before[base + row])
        for r in results:
            r["n_hit"] = sum(r["spans"][1::2]) - sum(r["spans"][::2])
        out += results
        base += n
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.int64())),
                      ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64()),
                      ("longest_item", pa.string())])
    return pa.array(out, kind)


def _join(now: dict, before: dict) -> None:
    """Adds the state of earlier blocks."""
    if before["longest"] >= now["longest"]:
        now |= {k: before[k] for k in ("longest", "longest_at", "longest_item")}
    now["items"] = sorted({*now["items"], *before["items"]})
    merged: list[int] = []
    pairs = sorted([*zip(now["spans"][::2], now["spans"][1::2]), *zip(before["spans"][::2], before["spans"][1::2])])
    for start, end in pairs:
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    now["spans"] = merged


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[Block]:
    """The driver holds one block of the benchmark at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("string")) \
            .where(F.col(text).isNotNull()).toLocalIterator():
        more = len(row[1].encode())
        if texts and size + more > block_bytes:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += more
    yield Block(ids, texts, window)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = WINDOW, into: str = "matches",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``into`` (see ``free_name``): n_words, n_hit, spans of hit words, sorted item ids, and the
    longest verbatim match with its word position and item."""
    into = free_name(docs, into)
    sc = docs.sparkSession.sparkContext
    state = None
    for number, block in enumerate(_blocks(benchmark, item_id, item_text, window, block_bytes)):
        if number:
            docs = pin(docs, "decontam")
        held = sc.broadcast(block)

        if state is None:
            @F.arrow_udf(_STATE)
            def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for texts in batches:
                    yield _search(texts, None, held.value)

            state = search.asNondeterministic()(F.col(text).cast("string"))
        else:
            @F.arrow_udf(_STATE)
            def search_on(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                for texts, states in batches:
                    yield _search(texts, states, held.value)

            state = search_on.asNondeterministic()(F.col(text).cast("string"), F.col(into))
        docs = docs.withColumn(into, state)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the texts that hold a window of any benchmark item."""
    into = free_name(docs, "matches")
    return benchmark_matches(docs, benchmark, text).where(F.col(into)["n_hit"] == 0).drop(into)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.col("matches")
    return benchmark_matches(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", m.n_words.alias("n_words"), m.n_hit.alias("n_hit"), F.size(m["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"), (m.n_hit > 0).alias("contaminated"))


def _split_sql(source: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"SELECT {key}, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {source}"


OP7_SQL = f"""
WITH d AS ({_split_sql('documents', 'doc_id')}), b AS ({_split_sql('benchmark', 'item_id')}),
windows AS (
  SELECT DISTINCT item_id, list_slice(words, i, i + least({WINDOW}, len(words)) - 1) AS g
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM windows),
places AS (
  SELECT doc_id, i, k, list_slice(words, i, i + k - 1) AS g
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, sizes WHERE len(words) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (g)),
words_hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit
              FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT cast(item_id AS VARCHAR), ',' ORDER BY cast(item_id AS VARCHAR)) AS ids
          FROM hits GROUP BY doc_id)
SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
