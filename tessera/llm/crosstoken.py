"""Alignment of two tokenizations of the same text by the byte offsets at which tokens of both end.

Tables from cumulative end to index are made for either tokenizer over a slice of texts; the ends that both have, in
ascending order, cut the two id lists into groups, and every slice is expanded into its links: the pairs of tokens whose byte ranges end
together. Texts stay in the task that reads them. Both encoders look up distinct pieces (``PieceEncoder``): the cuts are
places that no token of either vocabulary crosses.

How often a pair of ids is linked is counted over the whole corpus: distinct pairs per batch first, then one shuffle of
(a, b, n). In a link the bytes of one token are the end of the other's, so the number of pairs that can ever be linked
is fixed by the two vocabularies (``TokenBytes.possible_pairs``, 475,070 for the public ones); the counts are sent to the
tasks after a check against that bound.

Defined results: a null or empty text, and one whose joined token bytes of either side differ from space + text, has no
tokens and no groups (arrays are empty). Repeated rows are aligned and counted once each; null ids and other columns
are untouched; special strings inside texts are plain text. A token without bytes joins the group of its end, and is
linked with every token that ends there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from tessera.llm import words as W
from tessera.llm.common import free_name, pin, table
from tessera.llm.tokenfiles import ByteEncoder, PieceEncoder, public_tokenizer

_SPACE_MARK = "▁"
_PLAIN = W.byte_set(set(range(0x21, 0x7F)))                      # ASCII characters that are no white space
CACHED = 600_000         # pieces that a worker keeps for either tokenizer
SLICE_BYTES = 1 << 19    # texts are aligned in slices of about this size
LISTS = ("a", "b", "cut_a", "cut_b", "links")


class SentencePieces(PieceEncoder):
    """A SentencePiece model without text normalisation whose pieces hold the space mark at their front only.

    It gets space + text, and cuts it before a space between two printable ASCII characters, so every piece begins with a
    space. The model puts one before what it encodes, so the piece is given without it.
    """

    def __init__(self, model: bytes, cached: int = CACHED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        inner = any(_SPACE_MARK in self.model.id_to_piece(i).lstrip(_SPACE_MARK) for i in range(self.model.vocab_size()))
        plain = self.model.normalize(" a  b ") == _SPACE_MARK * 2 + "a" + _SPACE_MARK * 2 + "b" + _SPACE_MARK
        self.whole = inner or not plain                          # such a model gets whole texts
        super().__init__(cached)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        if self.whole:
            return begins
        at = np.flatnonzero(data == 0x20)
        row = np.searchsorted(offsets, at, "right") - 1
        at = at[(at > offsets[row]) & (at + 1 < offsets[row + 1])]
        return W.marked(len(data), begins, at[_PLAIN[data[at - 1]] & _PLAIN[data[at + 1]]])

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class TokenBytes:
    """The bytes of every token id of a vocabulary."""

    def __init__(self, by_id: list[bytes]):
        self.by_id = by_id
        self.width = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.begin = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        width = self.width[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(width) - width), width)
        return self.flat[at + np.arange(len(at))]

    def possible_pairs(self, other: "TokenBytes") -> int:
        """Pairs of ids in which the bytes of one token end those of the other."""
        mine, its = {}, {}
        for found, have in ((mine, self.by_id), (its, other.by_id)):
            for x in have:
                found[x] = found.get(x, 0) + 1
        pairs = sum(n * its.get(x[k:], 0) for x, n in mine.items() for k in range(len(x) + 1))
        return pairs + sum(n * mine.get(x[k:], 0) for x, n in its.items() for k in range(1, len(x) + 1))


def byte_level_bytes(vocabulary: dict[str, int]) -> TokenBytes:
    """Tokens of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes for those from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    made = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        made[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return TokenBytes(made)


def piece_bytes(model) -> TokenBytes:
    """Pieces of a SentencePiece model; the mark is a space, a byte piece is its byte, unknown and control pieces have none."""
    made = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            made.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_unknown(i) or model.is_control(i):
            made.append(b"")
        else:
            made.append(piece.replace(_SPACE_MARK, " ").encode())
    return TokenBytes(made)


class Aligner:
    """Two encoders with the bytes of their tokens."""

    def __init__(self, json: str, model: bytes):
        self.a, self.b = ByteEncoder(json, plain_specials=True, cached=CACHED), SentencePieces(model)
        self.a_bytes = byte_level_bytes(self.a.tokenizer.get_vocab(with_added_tokens=True))
        self.b_bytes = piece_bytes(self.b.model)
        size = max(len(self.a_bytes.by_id), len(self.b_bytes.by_id))
        digits = np.char.ljust(np.arange(size).astype("S"), len(str(size)))
        self.digits = digits.view(np.uint8).reshape(size, -1)
        self.n_digits = np.char.str_len(np.arange(size).astype("S")).astype(np.int64)

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * len(self.b_bytes.by_id) + b

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> "Slice":
        """The alignment of a slice of texts; the tables hold the ends of all its texts."""
        # space + text, and an empty text stays empty
        filled = offsets[1:] > offsets[:-1]
        spaced = np.insert(data, offsets[:-1][filled], 0x20)
        at = offsets.copy()
        at[1:] += np.cumsum(filled)
        sides, same = [], np.ones(len(filled), bool)
        for encoder, table_ in ((self.a, self.a_bytes), (self.b, self.b_bytes)):
            ids, sizes = encoder.encode(spaced, at)
            ids = ids.astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            same &= _same_texts(table_.joined(ids), np.bincount(row, table_.width[ids], len(sizes)).astype(np.int64), spaced, at)
            sides.append((ids, row, table_.width[ids]))
        found = []
        for ids, row, width in sides:
            if not same.all():
                kept = same[row]
                ids, row, width = ids[kept], row[kept], width[kept]
            # one more byte between texts: a token without bytes cannot end with the text before
            found.append((ids, row, np.cumsum(width) + row))
        (a, row_a, ends_a), (b, row_b, ends_b) = found
        by_a, by_b = _by_end(ends_a, len(spaced) + len(filled)), _by_end(ends_b, len(spaced) + len(filled))
        common = np.flatnonzero((by_a > 0) & (by_b > 0))
        cut_a, cut_b = by_a[common].astype(np.int64), by_b[common].astype(np.int64)
        row = row_a[cut_a - 1]
        links, n_links = self.code(a[cut_a - 1], b[cut_b - 1]), np.ones(len(common), np.int64)
        if np.count_nonzero(by_a) < len(a) or np.count_nonzero(by_b) < len(b):   # tokens without bytes: all that end at the cut are linked
            from_a, from_b = np.searchsorted(ends_a, common, "left"), np.searchsorted(ends_b, common, "left")
            links = np.concatenate([self.code(np.repeat(a[i:j], y - x), np.tile(b[x:y], j - i))
                                    for i, j, x, y in zip(from_a, cut_a, from_b, cut_b)])
            n_links = (cut_a - from_a) * (cut_b - from_b)
        count = lambda rows, weights=None: np.bincount(rows, weights, len(filled)).astype(np.int64)
        n_a, n_b, n_groups = count(row_a), count(row_b), count(row)
        return Slice(n_a, n_b, n_groups, count(row, n_links), a, b, cut_a - (np.cumsum(n_a) - n_a)[row], cut_b - (np.cumsum(n_b) - n_b)[row],
                     links, self._digests(a, b, cut_a, cut_b, n_a + n_b))

    def _digests(self, a, b, cut_a, cut_b, n_tokens) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2`` for each text: the ids of all groups in order, a separator behind each."""
        group_a = np.cumsum(np.bincount(cut_a, minlength=len(a) + 1))[:len(a)]
        group_b = np.cumsum(np.bincount(cut_b, minlength=len(b) + 1))[:len(b)]
        at_a = np.arange(len(a)) + np.concatenate([[0], cut_b])[group_a]
        at_b = np.arange(len(b)) + cut_a[group_b]
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        after = np.full(len(ids), ord(","), np.uint8)
        after[at_a[cut_a - 1]] = ord("|")
        after[at_b[cut_b - 1]] = ord(";")
        wide = self.n_digits[ids]
        cells = np.concatenate([self.digits[ids], np.zeros((len(ids), 1), np.uint8)], axis=1)
        cells[np.arange(len(ids)), wide] = after
        text = cells[np.arange(cells.shape[1]) <= wide[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(wide + 1)])[np.concatenate([[0], np.cumsum(n_tokens)])].tolist()
        return [hashlib.sha256(text[i:j - 1]).hexdigest() if i < j else "" for i, j in zip(ends[:-1], ends[1:])]


def _by_end(ends: np.ndarray, size: int) -> np.ndarray:
    """For each cumulative end below ``size``, one more than the index of the last token that ends there, or 0."""
    last = np.ones(len(ends), bool)
    last[:-1] = ends[1:] != ends[:-1]
    found = np.zeros(size, np.int32)
    found[ends[last]] = np.flatnonzero(last) + 1
    return found


def _same_texts(joined: np.ndarray, sizes: np.ndarray, texts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the joined bytes of each row's tokens are its text."""
    same = sizes == np.diff(offsets)
    if same.all() and np.array_equal(joined, texts):
        return same
    first = np.cumsum(sizes) - sizes
    for k in np.flatnonzero(same).tolist():
        same[k] = np.array_equal(joined[first[k]:first[k] + sizes[k]], texts[offsets[k]:offsets[k + 1]])
    return same


class Slice(NamedTuple):
    """Numbers for each text, and the lists of all texts one after another."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    links: np.ndarray
    groups_sha256: list[str]

    def arrow(self, lists: tuple[str, ...]) -> pa.StructArray:
        sizes = {"a": self.n_a, "b": self.n_b, "cut_a": self.n_groups, "cut_b": self.n_groups, "links": self.n_links}
        columns = [pa.array(x) for x in self[:4]]
        for name in lists:
            offsets = np.concatenate([[0], np.cumsum(sizes[name])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(getattr(self, name), pa.int64() if name == "links" else pa.int32())))
        return pa.StructArray.from_arrays([*columns, pa.array(self.groups_sha256, pa.string())], names=[*self._fields[:4], *lists, "groups_sha256"])


_ALIGNERS: dict[bytes, Aligner] = {}


def aligner(json: str, model: bytes) -> Aligner:
    """The worker's encoders for these two files."""
    key = hashlib.sha256(json.encode() + model).digest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(json, model)
    return _ALIGNERS[key]


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def align(docs: DataFrame, json: str, model: bytes, text: str = "text", into: str = "alignment",
          keep: list[str] | None = None, lists: tuple[str, ...] = LISTS) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a struct ``into`` (see ``free_name``): n_a, n_b, n_groups, n_links,
    groups_sha256, and the ``lists`` asked for: ids ``a`` and ``b``; the index after the last id of each group in either,
    ``cut_a`` and ``cut_b``; the ``links`` as a id * size of the b vocabulary + b id."""
    files = docs.sparkSession.sparkContext.broadcast((json, model))   # two tokenizer files, whose size does not grow
    keep = docs.columns if keep is None else keep
    into, given = free_name(docs, into), free_name(docs, "given_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(*files.value)
        for batch in batches:
            kept = batch.select(keep)
            for first, data, offsets in W.slices(batch.column(given), SLICE_BYTES):   # a slice goes on before the next is worked on
                found = made.slice(data, offsets).arrow(lists)
                yield pa.RecordBatch.from_arrays([*kept.slice(first, len(found)).columns, found], names=[*keep, into])

    numbers = [f"{x}:bigint" for x in Slice._fields[:4]]
    kinds = [f"{x}:array<{'bigint' if x == 'links' else 'int'}>" for x in lists]
    struct = DataType.fromDDL(f"struct<{','.join([*numbers, *kinds, 'groups_sha256:string'])}>")
    rows = docs.select(*keep, F.col(text).cast("string").alias(given))
    return rows.mapInArrow(cut, StructType([*[docs.schema[c] for c in keep], StructField(into, struct)]))


PART_ROWS = 512          # rows whose links are worked on at a time


def _parts(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    return (lists.slice(k, PART_ROWS) for k in range(0, len(lists), PART_ROWS))


def link_counts(links: DataFrame, column: str = "links") -> DataFrame:
    """(link, n): how many links of the corpus hold each pair of ids."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b.column(0)):
                pairs, n = np.unique(part.flatten().to_numpy(), return_counts=True)
                if len(pairs):
                    yield pa.record_batch([pa.array(pairs), pa.array(n, pa.int64())], names=["link", "n"])

    return links.select(column).mapInArrow(count, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def score_links(aligned: DataFrame, counts: DataFrame, json: str, model: bytes, column: str = "links",
                into: str = "link_scores") -> DataFrame:
    """``aligned`` with a struct ``into``: n_best (links whose count is the highest of their b id, ties included), count_sum."""
    made = aligner(json, model)
    most, width = made.a_bytes.possible_pairs(made.b_bytes), len(made.b_bytes.by_id)
    if counts.count() > most:
        raise ValueError("more pairs than the two vocabularies can link")
    got = counts.select("link", "n").toArrow()                   # at most ``most`` rows
    link, n = got.column("link").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(link)
    link, n = link[order], n[order]
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, link % width, n)
    sent = aligned.sparkSession.sparkContext.broadcast((link, n, n == highest[link % width]))

    @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        link, n, best = sent.value
        for lists in batches:
            found = [np.zeros((2, 0), np.int64)]
            for part in _parts(lists):
                sizes = part.value_lengths().fill_null(0).to_numpy()
                at = np.searchsorted(link, part.flatten().to_numpy())
                upto = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.concatenate([[0], np.cumsum(values[at], dtype=np.int64)])[upto] for values in (best, n)]
                found.append(np.diff(sums))
            n_best, total = np.concatenate(found, axis=1)
            yield pa.StructArray.from_arrays([pa.array(n_best), pa.array(total)], names=["n_best", "count_sum"])

    return aligned.withColumn(free_name(aligned, into), score(F.col(column)))


def op11(spark, sf_dir: str) -> DataFrame:
    json, model = public_tokenizer(), public_model()
    docs = table(spark, sf_dir, "documents")
    aligned = pin(align(docs, json, model, keep=["doc_id"], lists=("links",)).select("doc_id", "alignment.*"), "aligned")
    scored = score_links(aligned, link_counts(aligned), json, model)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "link_scores.n_best", "link_scores.count_sum", "groups_sha256")
