"""Quality rules, decontamination, token files and the classifier against plain versions on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import LOWER, edge_docs, no_docs, prose, row, rows, SCHEMA, words
from pyspark.sql import functions as F

from tessera.llm import decontam, milquality, repeats, tokenfiles
from tessera.llm import words as W
from tessera.llm.suffixes import longest_repeats


def plain_repeats(text):
    w = words(text, lower=False)

    def covered(k):
        seen = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        return len({i + j for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for j in range(k)})

    longest = 0
    while longest < len(w) and any(n > 1 for n in Counter(tuple(w[i:i + longest + 1]) for i in range(len(w) - longest)).values()):
        longest += 1
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": covered(8), "covered_words": covered(4), "longest_repeat": longest}


def test_repetition_counts_equal_plain_ones(spark):
    got = repeats.repetition_rules(edge_docs(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        want = plain_repeats(r["text"])
        have = r["_repetition"].asDict()
        assert {k: have[k] for k in want} == want, r["doc_id"]
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert have["base_failed"] == failed
        n = max(want["n_words"], 1)
        assert have["kept"] == (not failed and want["covered_words"] / n <= repeats.MAX_COVERED and want["longest_repeat"] / n <= repeats.MAX_LONGEST)
    assert repeats.repetition_rules(no_docs(spark)).count() == 0


def test_longest_repeats_on_random_sequences():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 300):
        s = r.integers(0, 3, n)
        ends = np.where(np.arange(n) < n // 2, n // 2, n)
        symbols = (s + 10 * (np.arange(n) >= n // 2)).astype(np.uint64)
        best = longest_repeats(symbols, ends)
        for p in range(n):
            def common(a, b):
                k = 0
                while a + k < ends[a] and b + k < ends[b] and symbols[a + k] == symbols[b + k]:
                    k += 1
                return k
            assert best[p] == max((common(p, q) for q in range(n) if q != p), default=0)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


ITEMS = [("b", " ".join(prose(1, 120).split(" ")[10:40])), ("a", " ".join(prose(1, 120).split(" ")[30:50])), ("short", "Two, WORDS"),
         (None, "one"), ("empty", ""), ("null", None), ("b", " ".join(prose(2, 90).split(" ")[:25])), ("none", prose(99, 40))]


def plain_matches(text):
    w = alnum(text)
    hit, items = set(), set()
    for item, t in ITEMS:
        b = alnum(t)
        k = min(10, len(b))
        windows = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in windows:
                hit.update(range(i, i + k))
                items.add(item or "")
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 60])
def test_decontamination_equals_plain_windows(spark, block_bytes):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontam.benchmark_matches(edge_docs(spark), benchmark, block_bytes=block_bytes).collect()
    assert len(got) == len(rows())
    for r in got:
        m = r["_matches"]
        assert (m["n_words"], m["n_hit"], m["items"]) == plain_matches(r["text"]), r["doc_id"]
        if m["n_hit"]:
            assert 1 <= m["longest"] <= m["n_hit"] and m["longest_item"] in m["items"]
    base = [r["_matches"] for r in got if r["doc_id"] == 1][0]
    assert (base["longest"], base["longest_at"]) == (30, len(alnum(" ".join(prose(1, 120).split(" ")[:10]))))


def test_decontamination_without_items_or_documents(spark):
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert decontam.decontaminate(edge_docs(spark), nothing).count() == len(rows())
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontam.decontaminate(no_docs(spark), benchmark).count() == 0
    left = decontam.decontaminate(edge_docs(spark), benchmark)
    assert left.columns == edge_docs(spark).columns
    assert left.count() == sum(plain_matches(x[1])[1] == 0 for x in rows())


def test_pieces_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    json = tokenfiles.public_tokenizer()
    whole, encoder = Tokenizer.from_str(json), tokenfiles.ByteEncoder(json)
    r = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "'s", "é", "à", "…", "1", "23", ".", "!!", " ", "　", "\x1c", " ", "\u0085", "中",
             "<|endoftext|>", "\r\n", "ab cd", " x"]
    texts = ["".join(r.choice(parts, r.integers(0, 14))) for _ in range(4000)] + [x[1] for x in rows()]
    for first, data, offsets in W.slices(pa.array(texts)):
        ids, sizes = encoder.encode(data, offsets)
        ends = np.cumsum(sizes)
        for i, end in enumerate(ends):
            assert ids[end - sizes[i]:end].tolist() == whole.encode(texts[first + i] or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    json = tokenfiles.public_tokenizer()
    whole = Tokenizer.from_str(json)
    manifest = tokenfiles.write_token_files(edge_docs(spark), str(tmp_path), json, sequence=16, batch=4)
    got = tokenfiles.read_token_files(spark, manifest).collect()
    ids = {i: [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in rows() if d == i] for i in {x[0] for x in rows()}}
    assert sorted((r["id"] is not None, r["id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, xs in ids.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    for m in manifest.collect():
        shard = tokenfiles.TokenShard(m["path"])
        n = -(-m["n_tokens"] // 16)
        seen = [shard.sequence_ids(k) for k in range(n)]
        assert sum(int(mask.sum()) for _, mask in seen) == m["n_tokens"] and all(len(x) == 16 for x, _ in seen)
        assert np.array_equal(np.concatenate([x[mask] for x, mask in seen]), shard.ids(0, m["n_tokens"]))
    empty = tokenfiles.write_token_files(no_docs(spark), str(tmp_path / "none"), json)
    assert tokenfiles.read_token_files(spark, empty).count() == 0


def test_classifier_learns_and_scores_awkward_rows(spark):
    good = [row(i, prose(i, 40 + i % 90)) for i in range(100, 220)]
    bad = [row(i, " ".join(x.upper() + "!!" for x in words(prose(i, 20 + i % 60)))) for i in range(220, 300)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(d[0], int(d[0] < 220)) for d in good + bad] + [(None, 1), (100, None)], "doc_id bigint, quality int")
    known = labels.where("doc_id % 3 <> 0 or doc_id is null")
    model = milquality.fit_quality(docs, known)
    scored = milquality.quality_scores(docs, model).where("doc_id % 3 = 0").collect()
    assert all((r["_quality_score"]["score"] >= milquality.THRESHOLD) == (r["doc_id"] < 220) for r in scored)
    edge = milquality.quality_scores(edge_docs(spark), model).collect()
    assert len(edge) == len(rows()) and all(0 <= r["_quality_score"]["score"] <= 1 for r in edge)
    long = [r for r in edge if r["doc_id"] == 12][0]["_quality_score"]
    assert long["n_passages"] == -(-len(words(prose(3, 9000))) // milquality.PASSAGE_WORDS)
    assert milquality.quality_scores(no_docs(spark), model).count() == 0
    blank = milquality.fit_quality(no_docs(spark), labels.limit(0))
    assert milquality.quality_scores(edge_docs(spark), blank).select(F.min("_quality_score.score")).head()[0] == 0.5


def test_classifier_steps_equal_plain_ones():
    r = np.random.default_rng(4)
    x, bags, y = r.normal(size=(23, milquality.WIDTH)).astype(np.float32), np.array([1, 5, 3, 8, 2, 4]), np.array([0, 1, 1, 0, 1, 0], np.float32)
    model = milquality.GatedAttention()
    model.p = {k: v + r.normal(size=v.shape).astype(np.float32) * 0.1 for k, v in model.p.items()}

    def loss(p):
        total, at = 0.0, 0
        for n, want in zip(bags, y):
            h = [np.tanh(row @ p["W"] + p["b"]) for row in x[at:at + n].astype(float)]
            e = [float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"]) for v in h]
            a = np.exp(e) / np.exp(e).sum()
            score = 1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, h)) @ p["c"] + float(np.ravel(p["c0"])[0]))))
            total -= (want * np.log(score) + (1 - want) * np.log(1 - score)) / len(y)
            at += n
        return total

    scores = model._forward(x, bags)[5]
    assert abs(loss(model.p) + np.mean(y * np.log(scores) + (1 - y) * np.log(1 - scores))) < 1e-5      # the forward pass
    # one step from zero moments goes against the sign of each gradient, by the rate
    start = {k: v.astype(float) for k, v in model.p.items()}
    wide = milquality.STEPS
    milquality.STEPS = 1
    try:
        mean, scale = x.mean(0), x.std(0) + 1e-3
        x = ((x - mean) / scale).astype(np.float32)
        model.fit(x * 1.0, bags, y)
    finally:
        milquality.STEPS = wide
    x = (x - x.mean(0)) / (x.std(0) + 1e-3)
    for name in ("W", "V", "U", "w", "c"):
        for place in list(np.ndindex(start[name].shape))[::7]:
            around = []
            for eps in (1e-4, -1e-4):
                p = {k: v.copy() for k, v in start.items()}
                p[name][place] += eps
                around.append(loss(p))
            slope = (around[0] - around[1]) / 2e-4 + milquality.DECAY * start[name][place]
            if abs(slope) > 1e-4:
                assert np.sign(start[name][place] - model.p[name][place]) == np.sign(slope), (name, place)


def test_sample_is_bounded_by_all_passages(spark):
    docs = spark.createDataFrame([row(i, prose(i, 300 if i % 2 else 40)) for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    model = milquality.fit_quality(docs, labels, sample_passages=60)
    assert model.constant is None
    none = milquality.fit_quality(docs, labels, sample_passages=0)
    assert none.constant == 0.5


def test_empty_items_digest_is_of_the_empty_text(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2(array_join(array(), ','), 256)").head()[0]


def thue_morse(n, a, b):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_words_of_two_letters_in_thue_morse_order_keep_apart(spark):
    from tokenizers import Tokenizer
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    (_, data, offsets), = W.slices(pa.array([x, y, x[:64], y[:64], x[:72], y[:72], "a", "a\0"]))
    assert len(set(W.keys(data, offsets[:-1], offsets[1:]).tolist())) == 8
    json = tokenfiles.public_tokenizer()
    library, encoder = Tokenizer.from_str(json), tokenfiles.ByteEncoder(json)
    ids, sizes = encoder.encode(data, offsets)
    assert ids[sizes[0]:sizes[0] + sizes[1]].tolist() == library.encode(y).ids
    docs = spark.createDataFrame([(1, x + " " + y), (2, y)], "doc_id long, text string")
    assert {r["doc_id"]: r["repetition"]["longest_repeat"] for r in repeats.repetition_rules(docs).collect()} == {1: 0, 2: 0}
    items = spark.createDataFrame([("i", x)], "item_id string, text string")
    hits = decontam.benchmark_matches(docs, items).select("doc_id", "matches.n_hit").collect()
    assert {r["doc_id"]: r["n_hit"] for r in hits} == {1: 1, 2: 0}


def test_pieces_with_equal_keys_are_encoded_apart(monkeypatch):
    from tokenizers import Tokenizer
    json = tokenfiles.public_tokenizer()
    library, encoder = Tokenizer.from_str(json), tokenfiles.ByteEncoder(json)
    monkeypatch.setattr(W, "keys", lambda data, starts, ends: ((ends - starts) % 2).astype(np.uint64))
    for texts in (["one word here", "another text", "one"], ["here two words", "", "one one"]):
        (_, data, offsets), = W.slices(pa.array(texts))
        ids, sizes = encoder.encode(data, offsets)
        assert ids.tolist() == [i for t in texts for i in library.encode(t).ids]
        assert sizes.tolist() == [len(library.encode(t).ids) for t in texts]
