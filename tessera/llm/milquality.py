"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded from its own text (shares of character
classes, word lengths, repeats, hashed words), a gated attention gives each passage a weight, and the document's score is a
logistic layer on the weighted sum of the encoded passages. Only documents have labels; the attention is learnt from them.

The model is fitted on all passages of at most ``SAMPLE_DOCS`` labelled documents, the first in the order of a hash of their
ids, and as many as have at most ``SAMPLE_PASSAGES`` passages together; these bound what the driver holds, whatever the
corpus. Scoring reads every passage of every text. Ids, sources, languages and labels are no inputs of a score.

Null and empty texts are one empty passage. Rows with equal ids share their label; contradicting labels of an id count by
their mean, null labels not at all. Without labels, or with one class only, every score is the mean label (0.5 if none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import free_name, mod_crc32, table

PASSAGE_WORDS = 64
SAMPLE_DOCS = 3000
SAMPLE_PASSAGES = 200_000   # passages of the sample in all
THRESHOLD = 0.3
HIDDEN, GATES, STEPS, RATE, DECAY = 24, 12, 150, 0.02, 1e-4
_HASHED = 24
_CLASSES = 12
_KIND = np.full(256, 8, np.int64)                  # other ASCII
for _code, _bytes in enumerate((b" ", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:",
                                b"!?", b"#*$%&@^~=+|<>{}[]\\/_")):
    _KIND[list(_bytes)] = _code
_KIND[0x80:0xC0] = 9                               # continuation bytes
_KIND[0xC0:] = 10                                  # lead bytes
WIDTH = _CLASSES + 8 + _HASHED


def passages(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice: (features of its passages in text order, number of passages of each text)."""
    for _, data, offsets in W.slices(texts):
        n_rows = len(offsets) - 1
        starts, ends, rows = W.spans(data, offsets, W.NOT_SPACE)
        n_words = W.count_by_row(rows, n_rows)
        bags = np.maximum(1, -(-n_words // PASSAGE_WORDS))
        first = np.cumsum(bags) - bags
        total = int(bags.sum())
        nth = np.arange(len(rows)) - (np.cumsum(n_words) - n_words)[rows]
        bag = first[rows] + nth // PASSAGE_WORDS
        x = np.zeros((total, WIDTH), np.float32)
        if len(rows):
            size = np.bincount(bag, minlength=total).astype(np.float32)
            some = np.maximum(size, 1)
            # every byte belongs to the passage of the last word that starts at or before it
            lengths = np.diff(np.append(starts, len(data)))
            byte_bag = np.repeat(bag, lengths)
            kinds = np.bincount(byte_bag * _CLASSES + _KIND[data[starts[0]:]], minlength=total * _CLASSES).reshape(total, _CLASSES)
            x[:, :_CLASSES] = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
            length = (ends - starts).astype(np.float32)
            keys = W.keys(W.LOWER[data], starts, ends)
            same = np.r_[False, (keys[1:] == keys[:-1]) & (bag[1:] == bag[:-1])]
            salted = np.sort(W.mix(keys + W.mix(bag.astype(np.uint64))))
            order = np.argsort(W.mix(keys + W.mix(bag.astype(np.uint64))), kind="stable")
            new = np.r_[True, salted[1:] != salted[:-1]]
            last = data[ends - 1]
            upper = _KIND[data[starts]] == 3
            upper &= _KIND[data[np.minimum(starts + 1, ends - 1)]] == 3
            mean = np.bincount(bag, length, total) / some
            at = _CLASSES
            for value in (mean / 10, np.sqrt(np.maximum(np.bincount(bag, length ** 2, total) / some - mean ** 2, 0)) / 10,
                          np.bincount(bag, same, total) / some, np.bincount(bag[order][new], minlength=total) / some,
                          np.bincount(bag, (_KIND[last] == 5) | (_KIND[last] == 6), total) / some,
                          np.bincount(bag, _KIND[last] == 7, total) / some, np.bincount(bag, upper, total) / some,
                          np.log1p(size) / 5):
                x[:, at] = value
                at += 1
            x[:, at:] = np.bincount(bag * _HASHED + (keys % np.uint64(_HASHED)).astype(np.int64),
                                    minlength=total * _HASHED).reshape(total, _HASHED) / some[:, None]
        yield x, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """tanh encoder, gated attention (tanh times sigmoid), logistic head; fitted by Adam on whole bags."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES),
                  "w": draw(GATES), "c": draw(HIDDEN), "c0": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, bags: np.ndarray):
        p = self.p
        first, owner = np.cumsum(bags) - bags, np.repeat(np.arange(len(bags)), bags)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[owner])
        a /= np.add.reduceat(a, first)[owner]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, s, a, z, _sigmoid(z @ p["c"] + p["c0"]), owner, first

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> "GatedAttention":
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, STEPS + 1):
            p = self.p
            h, t, s, a, z, score, owner, first = self._forward(x, bags)
            d = ((score - y) / len(y)).astype(np.float32)
            dz = d[:, None] * p["c"]
            da = (dz[owner] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, first)[owner])
            gate = de[:, None] * p["w"]
            dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
            dh = (a[:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            g = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ d, "c0": d.sum(keepdims=True)}
            for k in p:
                grad = g[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, largest attention weight) of each bag."""
        if self.constant is not None:
            return np.full(len(bags), self.constant), 1.0 / bags
        _, _, _, a, _, score, _, first = self._forward((x - self.mean) / self.scale, bags)
        return score.astype(float), np.maximum.reduceat(a, first).astype(float)


def _bags(text: Column) -> Column:
    """The features of all passages of each text, one after another."""
    @F.arrow_udf("array<float>")
    def bags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [part.ravel() for x, sizes in passages(texts) for part in np.split(x, np.cumsum(sizes)[:-1])]
            yield pa.array(out, pa.list_(pa.float32()))

    return bags(text)


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality",
                sample_docs: int = SAMPLE_DOCS, sample_passages: int = SAMPLE_PASSAGES) -> GatedAttention:
    """``labels`` holds the rows that may be learnt from. Of these, in hashed order, at most ``sample_docs`` documents are
    taken, as many as have at most ``sample_passages`` passages together (one that has more alone is passed over); of a
    document taken every passage is learnt from."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.avg(label).alias("_y"))
    sample = known.orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(sample_docs)
    # the sample is bounded by sample_docs rows of an id and a number
    tagged = docs.select(id_column, F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), id_column) \
        .withColumn("_t", F.md5(F.coalesce("_text", F.lit(""))))
    order = [F.md5(F.col(id_column).cast("string")), F.col(id_column), F.col("_t")]
    sizes = tagged.select(id_column, "_t", F.greatest(F.lit(1), F.ceil(F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) / PASSAGE_WORDS)).alias("_n")) \
        .where(F.col("_n") <= sample_passages).distinct().orderBy(*order).limit(sample_docs)
    upto = F.sum("_n").over(Window.orderBy(*order))              # over at most sample_docs rows
    chosen = sizes.withColumn("_upto", upto).where(F.col("_upto") <= sample_passages).select(id_column, "_t")
    rows = tagged.join(F.broadcast(chosen), [id_column, "_t"]).dropDuplicates([id_column, "_t"]).select(
        id_column, "_y", "_t", _bags(F.col("_text")).alias("_x")).orderBy(*order).collect()
    xs = [np.array(r["_x"], np.float32).reshape(-1, WIDTH) for r in rows]
    if not xs:
        return GatedAttention().fit(np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros(0, np.float32))
    return GatedAttention().fit(np.concatenate(xs), np.array([len(x) for x in xs]), np.array([r["_y"] for r in rows], np.float32))


def quality_scores(docs: DataFrame, model: GatedAttention, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a struct ``into`` (see ``free_name``): score, n_passages, attention (the largest weight of a passage)."""
    into = free_name(docs, into)

    @F.arrow_udf("struct<score:double,n_passages:bigint,attention:double>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [(*model.score(x, bags), bags) for x, bags in passages(texts)]
            column = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(column(0), pa.float64()), pa.array(column(2).astype(np.int64)),
                                              pa.array(column(1), pa.float64())], ["score", "n_passages", "attention"])

    return docs.withColumn(into, scores.asNondeterministic()(F.col(text).cast("string")))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit_quality(docs, labels.where(mod_crc32("doc_id", 5) != 0))
    s = F.col("quality_score")
    return quality_scores(docs, model).select("doc_id", (mod_crc32("doc_id", 5) == 0).alias("held_out"), s["score"].alias("score"),
                                              (s["score"] >= THRESHOLD).cast("int").alias("predicted"), s["n_passages"].alias("n_passages"))
