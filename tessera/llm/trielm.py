"""Language-model scores from an Elias-Fano n-gram trie that is spread over shards.

Levels: words, words after a word, and so on up to ``order`` (``ORDER``: three, so a context is up to two words). A word's
id is its place in the order of its 64-bit key, so ids rise over the shards of the vocabulary; the id of a longer entry is
its place in its level. A further level is keyed by (id of the parent entry, word) and kept in shards that are ranges of
it; a parent with a large share of all tokens is spread over all shards by ranges of the word.

A shard is one file. Words: an Elias-Fano sequence of the keys and one of the running counts. Further levels: Elias-Fano
sequences of the contexts, of monotone pointers to their first successors, of the successors (each relative to its context's
place, which makes them monotone) and, below the last level, of the running counts; and 8-bit codes of the discounted
probability c(v, w) / (c(v) + MU). Word counts are exact, so that the lowest probability is not rounded. Files are mapped
into memory and queried by successor search inside the context's range. ``trie.json`` names a trie's files;
``stored_scores`` scores any other text with it.

A token's probability after its context v is 10**code + MU / (c(v) + MU) * (its probability after v without v's first
word); a context that was not seen has c(v) = 0. Codes are rounded down, so probabilities never sum to more than one.
P(w) = (c(w) - D) / N, and D * V / N is what the class of all unknown words gets; D from the counts of one and two.

The corpus goes through in chunks of about ``CHUNK_BYTES`` of text: tokens as numbers of the chunk's own words, one file
for each chunk. Chunks send each distinct word, then, level by level, each distinct entry whose context was seen, once to
its shard, with its count in training documents. A shard's answers (ids, counts and codes) are one file, of which each chunk
reads its part, so answers are not shuffled; no model, vocabulary or text passes through the driver. Shards and chunks are bounded; with a larger corpus use larger chunks (a chunk sends one row to each
shard).

Tokens: words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end per document, which is also the context of the first
word; contexts do not reach past it. Null and empty texts are one end. Null ids are kept and hashed as empty texts; repeated
rows are scored each. Without training documents every probability is one.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import mod_crc32, pin, table
from tessera.llm.eliasfano import EliasFano
from tessera.llm.tokenfiles import _open
from tessera.session import scratch_path

ORDER = 3                      # words of the longest entries
CHUNK_BYTES = 8 << 20
SHARD_ENTRIES = 1_500_000      # words or longer entries that meet in one task, about
MU = 100.0
END = np.uint64(0xE5D0_0E5D_0E5D_0E5D)
_STEP = 8.0 / 255              # of the codes, in powers of ten from 0 down to -8


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative integers, compressed; rising ones are stored as differences."""
    numbers = numbers.astype(np.uint64)
    rising = len(numbers) > 1 and bool((numbers[1:] >= numbers[:-1]).all())
    if rising:
        numbers = np.diff(numbers, prepend=np.uint64(0))
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    head = len(numbers).to_bytes(6, "little") + bytes([width, rising])
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    n, width, rising = int.from_bytes(packed[:6], "little"), packed[6], packed[7]
    planes = np.frombuffer(pa.decompress(packed[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = planes.reshape(width, n).T
    numbers = wide.reshape(-1).view(np.uint64)
    return np.cumsum(numbers, dtype=np.uint64) if rising else numbers


def _load(uri: str) -> dict:
    """One chunk's file: docs, held, sizes, tokens, words."""
    files, path = _open(uri)
    with files.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all().to_pylist()[0]


def _chunks(docs: DataFrame, id_column: str, text: str, held: Column, chunk_bytes: int, folder: str) -> DataFrame:
    """Tokens of each document as numbers of the chunk's sorted distinct word keys, in one file of ``folder`` per chunk."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, keys, sizes, waiting, number = [], [], [], [], 0, 0

        def chunk() -> pa.RecordBatch:
            nonlocal number
            words, tokens = np.unique(np.concatenate(keys), return_inverse=True)
            held_in = pa.record_batch([
                pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                pa.ListArray.from_arrays(pa.array([0, sum(map(len, flags))], pa.int32()), pa.concat_arrays(flags)),
                pa.array([pack(np.concatenate(sizes))]), pa.array([pack(tokens)]), pa.array([pack(words)])],
                names=["docs", "held", "sizes", "tokens", "words"])
            uri = f"{folder}/{uuid.uuid4().hex}.arrow"
            files, path = _open(uri)
            files.create_dir(os.path.dirname(path), recursive=True)
            with files.open_output_stream(path) as f, pa.ipc.new_file(f, held_in.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(held_in)
            row = pa.record_batch({"chunk": pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
                                   "uri": pa.array([uri]), "n_words": pa.array([len(words)], pa.int64())})
            number += 1
            for x in (ids, flags, keys, sizes):
                x.clear()
            return row

        for b in batches:
            for first, data, offsets in W.slices(b.column(1)):
                data = W.LOWER[data]
                starts, ends, rows = W.spans(data, offsets, W.NOT_SPACE)
                n = W.count_by_row(rows, len(offsets) - 1)
                ids.append(b.column(0).slice(first, len(n)))
                flags.append(b.column(2).slice(first, len(n)))
                keys.append(np.insert(W.keys(data, starts, ends), np.cumsum(n), END))
                sizes.append(n + 1)
                waiting += len(data)
                if waiting >= chunk_bytes:
                    waiting = 0
                    yield chunk()
        if ids:
            yield chunk()

    return docs.select(F.col(id_column), F.col(text).cast("string"), held.alias("held")).mapInArrow(
        cut, "chunk bigint, uri string, n_words bigint")


def _training(held: list, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(~np.array(held, bool), sizes)


def _send_words(n_shards: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.to_pylist():
                row = _load(at["uri"])
                keys, tokens, sizes = unpack(row["words"]), unpack(row["tokens"]).astype(np.int64), unpack(row["sizes"]).astype(np.int64)
                counts = np.bincount(tokens[_training(row["held"], sizes)], minlength=len(keys))
                cuts = np.searchsorted(_word_shard(keys, n_shards), np.arange(n_shards + 1))
                some = [s for s in range(n_shards) if cuts[s] < cuts[s + 1]]
                yield pa.record_batch({"shard": pa.array(some, pa.int64()), "chunk": pa.array([at["chunk"]] * len(some), pa.int64()),
                                       "a": pa.array([pack(keys[cuts[s]:cuts[s + 1]]) for s in some], pa.binary()),
                                       "b": pa.array([pack(counts[cuts[s]:cuts[s + 1]]) for s in some], pa.binary())})

    return send


def _word_shard(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


_REPLY = ("shard bigint, chunk bigint, file string, place bigint, sizes array<bigint>, uri string, n_known bigint, n_tokens bigint, "
          "once bigint, twice bigint, often binary")


def _reply(group: pa.Table, columns: list[list], uri: str, counts: np.ndarray | None, folder: str) -> pa.Table:
    """Where the reply to each chunk lies: all replies of the shard are in one new file of ``folder``, and chunks read their
    own from there. The first row also has the shard's file and, of a new file, sizes and most frequent entries."""
    n = len(columns[0])
    replies = [[x or b"" for x in parts] for parts in zip(*columns)]
    file = f"{folder}/{uuid.uuid4().hex}.replies"
    files, path = _open(file)
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(path) as f:
        for parts in replies:
            f.write(b"".join(parts))
    sizes = [[len(x) for x in parts] for parts in replies]
    places = np.cumsum([0, *map(sum, sizes)])[:-1]
    first = lambda x, kind: pa.array([x] + [None] * (n - 1), kind)
    said = dict.fromkeys(("n_known", "n_tokens", "once", "twice"))
    often = None
    if counts is not None:
        most = np.sort(np.argsort(counts, kind="stable")[-64:])
        often = pack(np.concatenate([most, counts[most]]))
        said = {"n_known": len(counts), "n_tokens": int(counts.sum()), "once": int((counts == 1).sum()), "twice": int((counts == 2).sum())}
    return pa.table({"shard": group["shard"], "chunk": group["chunk"], "file": pa.array([file] * n), "place": pa.array(places, pa.int64()),
                     "sizes": pa.array(sizes, pa.list_(pa.int64())), "uri": first(uri, pa.string()), **{k: first(x, pa.int64()) for k, x in said.items()}, "often": first(often, pa.binary())})


def _replies(rows: list[dict]) -> list[dict]:
    """The rows with their packed columns a, b and c, read from the files."""
    for row in rows:
        files, path = _open(row["file"])
        with files.open_input_file(path) as f:
            f.seek(row["place"])
            for name, size in zip("abc", row["sizes"]):
                row[name] = f.read(size)
    return rows


def _answer_words(folder: str, stored: dict | None, replies: str):
    """Of a vocabulary shard: for each chunk its words' counts in all training documents, and their places among the known words."""
    def answer(group: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in group["a"].to_pylist()]
        shard = group["shard"][0].as_py()
        cuts = np.cumsum([0, *map(len, parts)])
        wanted = np.concatenate(parts)
        if stored is None:
            keys, at = np.unique(wanted, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([unpack(x) for x in group["b"].to_pylist()]).astype(np.int64))
            known = total > 0
            uri = f"{folder}/level-1-shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.trie"
            WordShard.write(keys[known], total[known], uri)
            new = total[known]
        else:
            uri, new = stored["uris"].get(shard), None
        counts, place = WordShard(uri).entries(wanted) if uri else (np.zeros(len(wanted), np.int64),) * 2
        return _reply(group, [[pack(place[s:e]) for s, e in zip(cuts, cuts[1:])], [pack(counts[s:e]) for s, e in zip(cuts, cuts[1:])],
                              [None] * len(parts)], uri, new, replies)

    return answer


class _Model:
    """Sizes that the tasks need, level by level: bounded by the number of shards."""

    def __init__(self, order: int, word_shards: int, shard_entries: int):
        self.order, self.word_shards, self.shard_entries, self.levels = order, word_shards, shard_entries, []
        self.V = self.N = 0
        self.D, self.shards = 0.5, 1

    def add(self, stats: list) -> None:
        """The next level, from the first replies of its shards."""
        stats = sorted(stats, key=lambda r: r["shard"])
        known = [r["n_known"] for r in stats]
        base = {r["shard"]: sum(known[:i]) for i, r in enumerate(stats)}
        if not self.levels:
            self.V, self.N = sum(known), sum(r["n_tokens"] for r in stats)
            once, twice = sum(r["once"] for r in stats), sum(r["twice"] for r in stats)
            self.D = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
            # tokens of a chunk bound its entries of a level; about 0.7 of the pairs are distinct
            self.shards = max(1, -(-self.N // self.shard_entries))
        often = [(base[r["shard"]] + int(p), int(c)) for r in stats for p, c in zip(*np.split(unpack(r["often"]), 2))]
        if sum(known) * self.V >= 1 << 64:
            raise ValueError("too many entries for 64-bit numbers of (entry, word)")
        self.levels.append({"base": base, "uris": {r["shard"]: r["uri"] for r in stats}, "total": sum(known),
                            "hot": np.array(sorted(w for w, c in often if c * 4 * self.shards > self.N), np.uint64)})

    def save(self, folder: str) -> None:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        levels = [{"base": list(x["base"].items()), "uris": [(s, os.path.basename(u)) for s, u in x["uris"].items()],
                   "total": x["total"], "hot": x["hot"].tolist()} for x in self.levels]
        with files.open_output_stream(f"{path}/trie.json") as f:
            f.write(json.dumps(self.__dict__ | {"levels": levels}).encode())

    @classmethod
    def load(cls, folder: str) -> "_Model":
        files, path = _open(folder)
        with files.open_input_stream(f"{path}/trie.json") as f:
            held = json.loads(f.read())
        model = cls(0, 1, 1)
        model.__dict__.update(held | {"levels": [
            {"base": dict(x["base"]), "uris": {s: f"{folder}/{u}" for s, u in x["uris"]}, "total": x["total"],
             "hot": np.array(x["hot"], np.uint64)} for x in held["levels"]]})
        return model

    @property
    def universe(self) -> np.uint64:
        return np.uint64(max(self.V, 1))

    def words(self, replies: list[dict], n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(count, id) of the chunk's words; unknown ones have a count of 0 and no meaningful id."""
        replies = sorted(replies, key=lambda r: r["shard"])
        base = self.levels[0]["base"]
        ids = np.concatenate([unpack(r["a"]).astype(np.int64) + base.get(r["shard"], 0) for r in replies])
        counts = np.concatenate([unpack(r["b"]) for r in replies]).astype(np.int64)
        assert len(counts) == n_words
        return counts, ids

    def split(self, level: int, keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(shard, numbers of its keys, in their order) of keys (context, word) of a level."""
        above = self.levels[level - 2]
        spread = lambda x, total: (x * np.uint64(self.shards) // np.uint64(max(total, 1))).astype(np.int64)
        context, word = keys // self.universe, keys % self.universe
        shard = spread(context, above["total"])
        hot = np.isin(context, above["hot"])
        shard[hot] = (shard[hot] + spread(word[hot], self.V)) % self.shards
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        return [(s, order[cuts[s]:cuts[s + 1]]) for s in range(self.shards) if cuts[s] < cuts[s + 1]]


def _open_chunk(chunk: pa.Table, replies: pa.Table, model: _Model, upto: int):
    """A chunk with its entries at the levels 2 to ``upto``: (sorted distinct keys context * universe + word, key number of
    each token or -1, count of each token's context, 1 + code of each key as far as there are replies)."""
    at = chunk.to_pylist()[0]
    row = _load(at["uri"]) | {"chunk": at["chunk"]}
    tokens, sizes = unpack(row["tokens"]).astype(np.int64), unpack(row["sizes"]).astype(np.int64)
    answers = _replies(replies.to_pylist())
    counts, ids = model.words([r for r in answers if r["level"] == 1], at["n_words"])
    first, end = np.cumsum(sizes) - sizes, int(tokens[-1])
    count, entry = counts[tokens], ids[tokens]           # of the entry that ends at each token
    words, known, levels = ids[tokens].astype(np.uint64), count > 0, []
    for level in range(2, upto + 1):
        of_context, context = np.roll(count, 1), np.roll(entry, 1)
        of_context[first], context[first] = (counts[end], ids[end]) if level == 2 else (0, 0)
        usable = np.flatnonzero((of_context > 0) & known)
        keys, number = np.unique(context[usable].astype(np.uint64) * model.universe + words[usable], return_inverse=True)
        codes, key_count, key_id = (np.zeros(len(keys), np.int64) for _ in range(3))
        by_shard = {r["shard"]: r for r in answers if r["level"] == level}
        if by_shard:
            base = model.levels[level - 1]["base"]
            for shard, mine in model.split(level, keys):
                r = by_shard[shard]
                codes[mine] = unpack(r["a"]).astype(np.int64)
                if level < model.order:
                    key_id[mine] = unpack(r["b"]).astype(np.int64) + base.get(shard, 0)
                    key_count[mine] = unpack(r["c"]).astype(np.int64)
        of_token = np.full(len(tokens), -1, np.int64)
        of_token[usable] = number
        levels.append((keys, of_token, of_context, codes))
        count, entry = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        count[usable], entry[usable] = key_count[number], key_id[number]
    return row, tokens, sizes, counts, levels


_SENT = "shard bigint, chunk bigint, a binary, b binary, c binary"


def _send(model: _Model, level: int):
    def send(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row, _, sizes, _, levels = _open_chunk(chunk, replies, model, level)
        keys, number, count, _ = levels[-1]
        trained = np.bincount(number[_training(row["held"], sizes) & (number >= 0)], minlength=len(keys))
        of_context = np.zeros(len(keys), np.int64)
        of_context[number[number >= 0]] = count[number >= 0]
        out = []
        for shard, at in model.split(level, keys):
            v = keys[at] // model.universe
            head = np.r_[True, v[1:] != v[:-1]]
            out.append((shard, pack(keys[at]), pack(trained[at]), pack(of_context[at][head])))
        column = lambda i, kind: pa.array([x[i] for x in out], kind)
        return pa.table({"shard": column(0, pa.int64()), "chunk": pa.array([row["chunk"]] * len(out), pa.int64()),
                         "a": column(1, pa.binary()), "b": column(2, pa.binary()), "c": column(3, pa.binary())})

    return send


class _File:
    """Elias-Fano sequences and plain arrays in one file that is mapped into memory."""

    @staticmethod
    def store(uri: str, sequences: list[EliasFano], plain: list[np.ndarray], **meta) -> None:
        arrays = [a for x in sequences for a in x.arrays()] + plain
        meta |= {"sequences": [[x.n, x.width] for x in sequences], "arrays": []}
        at = 0
        for a in arrays:
            meta["arrays"].append([a.dtype.str, len(a), at])
            at += -(-a.nbytes // 64) * 64
        header = json.dumps(meta).encode()
        files, path = _open(uri)
        files.create_dir(os.path.dirname(path), recursive=True)
        with files.open_output_stream(path) as f:
            f.write((len(header).to_bytes(8, "little") + header).ljust(4096, b" "))
            for a in arrays:
                f.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.copied = None
        if files.type_name != "local":                 # a store that cannot be mapped: a copy for the time of the task
            self.copied = tempfile.NamedTemporaryFile()
            with files.open_input_stream(path) as f:
                while part := f.read(1 << 22):
                    self.copied.write(part)
            self.copied.flush()
            path = self.copied.name
        raw = np.memmap(path, np.uint8, "r")
        self.meta = json.loads(raw[8:8 + int.from_bytes(raw[:8].tobytes(), "little")].tobytes())
        arrays = [raw[4096 + at:4096 + at + n * np.dtype(kind).itemsize].view(kind) for kind, n, at in self.meta["arrays"]]
        self.sequences = [EliasFano(*size, *arrays[3 * i:3 * i + 3]) for i, size in enumerate(self.meta["sequences"])]
        self.plain = arrays[3 * len(self.sequences):]

    @staticmethod
    def running(counts: np.ndarray) -> EliasFano:
        return EliasFano.of(np.cumsum(np.r_[0, counts]))

    def counts_at(self, running: EliasFano, at: np.ndarray) -> np.ndarray:
        return (running.get(at + 1) - running.get(at)).astype(np.int64)


class WordShard(_File):
    """One file of the trie's first level."""

    @classmethod
    def write(cls, keys: np.ndarray, counts: np.ndarray, uri: str) -> None:
        """``keys`` are sorted and have been seen."""
        cls.store(uri, [EliasFano.of(keys), cls.running(counts)], [])

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, place) of each word key, a count of 0 for words that the trie does not have."""
        held, running = self.sequences
        counts = np.zeros(len(keys), np.int64)
        if not held.n:
            return counts, counts
        place, there = held.successor(keys)
        counts[there] = self.counts_at(running, place[there])
        return counts, place


class TrieShard(_File):
    """One file of a further level of the trie."""

    @classmethod
    def write(cls, keys: np.ndarray, counts: np.ndarray, context_counts: np.ndarray, universe: int, uri: str, last: bool) -> None:
        """``keys`` are sorted and have been seen; ``context_counts`` has c(v) of each. The last level needs no counts."""
        v, w = keys // np.uint64(universe), keys % np.uint64(universe)
        head = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
        place = np.cumsum(head) - 1
        exponent = np.log10(counts / (context_counts + MU)) if len(counts) else np.zeros(0)
        codes = np.clip(np.ceil(-exponent / _STEP), 0, 255).astype(np.uint8)
        sequences = [EliasFano.of(v[head]), EliasFano.of(np.append(np.flatnonzero(head), len(v))),
                     EliasFano.of(place.astype(np.uint64) * np.uint64(universe) + w)]
        cls.store(uri, sequences + ([] if last else [cls.running(counts)]), [codes], universe=universe)

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(1 + code, count, place) of each key, a code of 0 for keys that the trie does not have; the last level has no counts."""
        contexts, pointers, successors, *running = self.sequences
        codes, counts, places = (np.zeros(len(keys), np.int64) for _ in range(3))
        if not contexts.n:
            return codes, counts, places
        universe = np.uint64(self.meta["universe"])
        context, known = contexts.successor(keys // universe)
        context = context[known]
        child, there = successors.successor(context.astype(np.uint64) * universe + keys[known] % universe)
        there &= (child >= pointers.get(context).astype(np.int64)) & (child < pointers.get(context + 1).astype(np.int64))
        found, child = np.flatnonzero(known)[there], child[there]
        codes[found], places[found] = self.plain[0][child].astype(np.int64) + 1, child
        if running:
            counts[found] = self.counts_at(running[0], child)
        return codes, counts, places


def _answer(folder: str, universe: int, level: int, last: bool, stored: dict | None, replies: str):
    """Of a shard of a further level: for each chunk its keys' codes and, below the last level, places and counts."""
    def answer(group: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in group["a"].to_pylist()]
        shard = group["shard"][0].as_py()
        keys, example, at = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        if stored is None:
            of_context = []
            for part, c in zip(parts, group["c"].to_pylist()):
                v = part // np.uint64(universe)
                of_context.append(unpack(c).astype(np.int64)[np.cumsum(np.r_[True, v[1:] != v[:-1]]) - 1])
            of_context = np.concatenate(of_context)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([unpack(x) for x in group["b"].to_pylist()]).astype(np.int64))
            seen = total > 0
            uri = f"{folder}/level-{level}-shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.trie"
            TrieShard.write(keys[seen], total[seen], of_context[example][seen], universe, uri, last)
            new = total[seen]
        else:
            uri, new = stored["uris"].get(shard), None
        codes, counts, places = TrieShard(uri).entries(keys) if uri else (np.zeros(len(keys), np.int64),) * 3
        cuts = np.cumsum([0, *map(len, parts)])
        packed = lambda x: [pack(x[at[s:e]]) for s, e in zip(cuts, cuts[1:])]
        none = [None] * len(parts)
        return _reply(group, [packed(codes), none if last else packed(places), none if last else packed(counts)], uri, new, replies)

    return answer


def _score_chunk(model: _Model, id_type: pa.DataType):
    def score(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        row, tokens, sizes, counts, levels = _open_chunk(chunk, replies, model, model.order)
        known = counts[tokens] > 0
        n, base = max(model.N, 1), np.log10((counts + 1) / (model.N + model.V + 1))
        unigram = np.where(counts > 0, (counts - model.D) / n, model.D * model.V / n)
        if not model.N:
            unigram[:] = 1.0
        p = unigram[tokens]
        for _, number, of_context, codes in levels:
            own = np.append(codes, 0)[number]          # -1 takes the last: no entry
            p = np.where(own > 0, 10.0 ** (-(own - 1) * _STEP), 0.0) + MU / (of_context + MU) * p
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, first)
        k = len(sizes)
        return pa.table({"id": pa.array(row["docs"], id_type), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": sizes,
                         "n_known": add(known.astype(np.int64)), "train_tokens": np.full(k, model.N, np.int64),
                         "base_score": add(base[tokens]), "score": add(np.log10(p))})

    return score


def _run(docs: DataFrame, held: Column, id_column: str, text: str, chunk_bytes: int, folder: str, model: _Model | None,
         order: int, shard_entries: int) -> DataFrame:
    """Scores; without ``model`` its levels are counted and written first."""
    spark, learn = docs.sparkSession, model is None
    chunks = pin(_chunks(docs, id_column, text, held, chunk_bytes, scratch_path(spark, "tokens")), "chunks")
    if learn:
        entries = chunks.agg(F.sum("n_words")).head()[0] or 0
        model = _Model(order, max(1, -(-entries // shard_entries)), shard_entries)
    stored = lambda level: None if learn else model.levels[level - 1]
    asked = chunks.mapInArrow(_send_words(model.word_shards), "shard bigint, chunk bigint, a binary, b binary")
    replies, files = None, scratch_path(spark, "replies")
    for level in range(1, model.order + 1):
        if level == 1:
            answer = _answer_words(folder, stored(1), files)
        else:
            asked = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_send(model, level), _SENT)
            answer = _answer(folder, int(model.universe), level, level == model.order, stored(level), files)
        answered = pin(asked.groupBy("shard").applyInArrow(answer, _REPLY), f"level{level}")
        if learn:
            model.add(answered.where("uri is not null").drop("file", "place", "sizes", "chunk").collect())      # one row for each shard
        mine = answered.select("chunk", "shard", "file", "place", "sizes", F.lit(level).alias("level"))
        replies = mine if replies is None else replies.unionByName(mine)
    if learn:
        model.save(folder)
    kind = docs.schema[id_column].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    scored = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        _score_chunk(model, to_arrow_type(kind)),
        f"id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.withColumnRenamed("id", id_column)


def train_trie(docs: DataFrame, held: Column, id_column: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES,
               shard_entries: int = SHARD_ENTRIES, order: int = ORDER) -> tuple[DataFrame, str]:
    """(scores, folder of the trie). One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    ``held`` marks the documents that the model does not learn from. The folder is in the shared store."""
    if order < 2:
        raise ValueError("the trie has at least two levels")
    folder = scratch_path(docs.sparkSession, "trie")
    return _run(docs, held, id_column, text, chunk_bytes, folder, None, order, shard_entries), folder


def stored_scores(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``train_trie`` for any documents, from the trie in ``folder``; nothing is learnt from them (``held_out``)."""
    model = _Model.load(folder)
    return _run(docs, F.lit(True), id_column, text, chunk_bytes, folder, model, model.order, model.shard_entries)


def trie_scores(docs: DataFrame, held: Column, id_column: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES,
                shard_entries: int = SHARD_ENTRIES, order: int = ORDER) -> DataFrame:
    """The scores of ``train_trie`` alone."""
    return train_trie(docs, held, id_column, text, chunk_bytes, shard_entries, order)[0]


def op2(spark, sf_dir: str) -> DataFrame:
    return train_trie(table(spark, sf_dir, "documents"), mod_crc32("doc_id", 7) == 2)[0]
