"""Cross-tokenizer alignment against a plain version that encodes whole texts and compares all token pairs."""

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from edge import edge_docs, no_docs, prose, rows
from pyspark.sql import functions as F

from tessera.llm import crosstoken
from tessera.llm import words as W
from tessera.llm.tokenfiles import public_tokenizer

PARTS = [" ", "  ", "\n", "\t", "a", "bc", "'s", "é", "à", "…", "1", "23", ".", "!!", " ", "　", "\x1c", "▁", "\u0085", "中",
         "<|endoftext|>", "<s>", "<0x0A>", "\r\n", "ab cd", " x", "\x00", "🙂", "word", " word", "ﬁ", "é"]


def random_texts(n):
    r = np.random.default_rng(3)
    return ["".join(r.choice(PARTS, r.integers(0, 16))) for _ in range(n)]


class Plain:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(public_tokenizer())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=crosstoken.public_model())
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.byte = {chr(x): x for x in shown}
        for k, x in enumerate(x for x in range(256) if x not in shown):
            self.byte[chr(256 + k)] = x

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_unknown(i) or self.b.is_control(i) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        """(groups of (a ids, b ids), links): pairs of tokens that end together."""
        if not text:
            return [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text)
        mine = [bytes(self.byte[c] for c in t) for t in a.tokens]
        its = [self.b_bytes(i) for i in b]
        if b"".join(mine) != (" " + text).encode() or b"".join(its) != (" " + text).encode():
            return [], []
        a_ends, b_ends = np.cumsum(list(map(len, mine))).tolist(), np.cumsum(list(map(len, its))).tolist()
        common = sorted(set(a_ends) & set(b_ends))
        groups = [([], []) for _ in common]
        for side, ids, ends in ((0, a.ids, a_ends), (1, b, b_ends)):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(common, e)][side].append(i)
        at = defaultdict(list)
        for j, f in zip(b, b_ends):
            at[f].append(j)
        return groups, [(i, j) for i, e in zip(a.ids, a_ends) for j in at.get(e, ())]


def digest(groups):
    if not groups:
        return ""
    return hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest()


def by_text(found):
    """(a, b, cut_a, cut_b, links, digest) of each text of a slice."""
    cut = lambda flat, sizes: np.split(flat, np.cumsum(sizes)[:-1])
    return zip(cut(found.a, found.n_a), cut(found.b, found.n_b), cut(found.cut_a, found.n_groups), cut(found.cut_b, found.n_groups),
               cut(found.links, found.n_links), found.groups_sha256)


def test_slices_equal_whole_texts():
    plain, made = Plain(), crosstoken.aligner(public_tokenizer(), crosstoken.public_model())
    texts = random_texts(1500) + [x[1] for x in rows()]
    got = [r for _, data, offsets in W.slices(pa.array(texts), 3000) for r in by_text(made.slice(data, offsets))]
    refused = 0
    for text, (a, b, cut_a, cut_b, links, sha) in zip(texts, got, strict=True):
        groups, pairs = plain(text)
        refused += bool(text) and not groups
        before = np.concatenate([[0], cut_a[:-1]]).astype(int), np.concatenate([[0], cut_b[:-1]]).astype(int)
        have = [(a[i:j].tolist(), b[x:y].tolist()) for i, j, x, y in zip(before[0], cut_a, before[1], cut_b)]
        assert have == groups and sha == digest(groups), repr(text)
        assert sorted(links.tolist()) == sorted(i * 32000 + j for i, j in pairs)
    assert refused                                               # texts that hold the space mark itself


def test_counts_and_best_links_cover_the_corpus(spark):
    plain = Plain()
    given = [(i, t) for i, t in enumerate(random_texts(300))] + [(x[0], x[1]) for x in rows()]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("alignment", F.lit("kept")).repartition(4)
    json, model = public_tokenizer(), crosstoken.public_model()
    aligned = crosstoken.align(docs, json, model).select("doc_id", "alignment", F.col("_alignment.links").alias("links"))
    counts = crosstoken.link_counts(aligned)
    got = crosstoken.score_links(aligned, counts, json, model).collect()
    every = [(i, plain(t)) for i, t in given]
    n = Counter(p for _, (_, pairs) in every for p in pairs)
    assert {r["link"]: r["n"] for r in counts.collect()} == {i * 32000 + j: k for (i, j), k in n.items()}
    highest = {}
    for (_, j), k in n.items():
        highest[j] = max(highest.get(j, 0), k)
    want = sorted((str(i), len(pairs), sum(n[p] == highest[p[1]] for p in pairs), sum(n[p] for p in pairs)) for i, (_, pairs) in every)
    assert sorted((str(r["doc_id"]), len(r["links"]), r["link_scores"]["n_best"], r["link_scores"]["count_sum"]) for r in got) == want
    assert {r["alignment"] for r in got} == {"kept"}
    assert len(n) <= crosstoken.aligner(json, model).a_bytes.possible_pairs(crosstoken.aligner(json, model).b_bytes)


def test_empty_tables_and_extra_columns(spark):
    json, model = public_tokenizer(), crosstoken.public_model()
    none = crosstoken.align(no_docs(spark), json, model).select("doc_id", F.col("alignment.links").alias("links"))
    assert crosstoken.score_links(none, crosstoken.link_counts(none), json, model).count() == 0
    kept = crosstoken.align(edge_docs(spark), json, model)
    assert kept.columns == [*edge_docs(spark).columns, "alignment"] and kept.count() == len(rows())


def test_tokens_without_bytes_are_linked_with_all_that_end_there(monkeypatch):
    made = crosstoken.Aligner(public_tokenizer(), crosstoken.public_model())

    def encoder(ids, sizes):
        return type("E", (), {"encode": lambda self, data, offsets: (np.array(ids), np.array(sizes))})()

    # ' ab' twice; the second b side has a token without bytes at its front and one at its end
    one = {x: made.a_bytes.by_id.index(x) for x in (b" ", b"a", b"b")}
    two = {x: made.b_bytes.by_id.index(x) for x in (b" a", b"b", b"")}
    made.a, made.b = encoder([one[b" "], one[b"a"], one[b"b"]] * 2, [3, 3]), encoder([two[b" a"], two[b"b"], two[b""], two[b" a"], two[b"b"], two[b""]], [2, 4])
    first, second = by_text(made.slice(np.frombuffer(b"abab", np.uint8), np.array([0, 2, 4])))
    assert first[2].tolist() == [2, 3] and first[3].tolist() == [1, 2]
    assert second[2].tolist() == [2, 3] and second[3].tolist() == [2, 4]
    code = lambda x, y: one[x] * 32000 + two[y]
    assert second[4].tolist() == [code(b"a", b" a"), code(b"b", b"b"), code(b"b", b"")]
    groups = [([one[b" "], one[b"a"]], [two[b""], two[b" a"]]), ([one[b"b"]], [two[b"b"], two[b""]])]
    assert second[5] == digest(groups)


def test_a_very_long_text_is_one_row(spark):
    text = prose(31, 60_000)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    json, model = public_tokenizer(), crosstoken.public_model()
    got = crosstoken.align(docs, json, model).select("alignment.*").head()
    plain = Plain()
    assert got["a"] == plain.a.encode(" " + text, add_special_tokens=False).ids and got["b"] == plain.b.encode(text)
    assert got["cut_a"][-1] == len(got["a"]) and got["cut_b"][-1] == len(got["b"])
