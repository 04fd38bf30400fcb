"""Near-duplicates, mixing, line runs, language model, chat, fixity and the pipeline against plain versions."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge import SCHEMA, edge_docs, no_docs, prose, row, rows, words
from pyspark.sql import functions as F

from tessera.llm import chat, fixity, lineruns, mixing, orderhash, trielm
from tessera.llm.common import mod_crc32
from tessera.llm.components import components
from tessera.llm.eliasfano import EliasFano


# near-duplicates

def plain_groups(texts, least=0.8):
    """text -> frozenset of the texts of its group, by all pairs."""
    def shingles(t):
        w = words(t)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    distinct = sorted({t or "" for t in texts})
    sets = [shingles(t) for t in distinct]
    parent = list(range(len(distinct)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(distinct)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= least * len(sets[i] | sets[j]):
            parent[top(i)] = top(j)
    groups = defaultdict(set)
    for i, t in enumerate(distinct):
        groups[top(i)].add(t)
    return {t: frozenset(groups[top(i)]) for i, t in enumerate(distinct)}


def near_rows():
    r = random.Random(4)
    made = []
    for g in range(6):
        base = prose(50 + g, 60 + 30 * g).split(" ")
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(["new", "word", "here"])
            made.append(" ".join(copy))
    hot = prose(77, 150).split(" ")                     # one group larger than a tile, not all alike
    for i in range(150):
        copy = list(hot)
        for k in range(r.randint(1, 5)):
            copy[r.randrange(len(copy))] = f"w{r.randint(0, 9)}"
        made.append(" ".join(copy))
    return rows() + [row(1000 + i, t) for i, t in enumerate(made)]


def test_groups_equal_those_of_all_pairs(spark):
    given = near_rows()
    docs = spark.createDataFrame(given, SCHEMA).repartition(5)
    got = {bytes(r["node"]): r for r in orderhash.near_duplicate_groups(docs).collect()}
    want = plain_groups([x[1] for x in given])
    by_label = defaultdict(set)
    node = {t: hashlib.sha256(t.encode()).digest()[:16] for t in want}
    for t in want:
        by_label[bytes(got[node[t]]["label"])].add(t)
    assert {frozenset(x) for x in by_label.values()} == set(want.values())
    kept = orderhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert len(left) == len(set(want.values()))
    assert {want[r["text"] or ""] for r in left} == set(want.values())
    for r in left:
        ids = [x[0] for x in given if (x[1] or "") in want[r["text"] or ""]]
        assert r["doc_id"] == (min(i for i in ids if i is not None) if any(i is not None for i in ids) else None)


def test_no_documents_have_no_groups(spark):
    assert orderhash.near_duplicate_groups(no_docs(spark)).count() == 0
    assert orderhash.drop_near_duplicates(no_docs(spark)).count() == 0


def test_banded_alignment_equals_full_alignment():
    r = np.random.default_rng(2)
    pairs = []
    for n in (1, 5, 40, 90):
        for _ in range(12):
            x = r.integers(0, 4, n)
            y = np.delete(x, r.integers(0, n, n // 6)) if n > 5 else r.integers(0, 4, r.integers(1, 6))
            pairs.append((x, np.insert(y, r.integers(0, len(y) + 1, n // 8), 9)))

    def full(x, y):
        d = np.arange(len(y) + 1)
        for a in x:
            e = [d[0] + 1]
            for j, b in enumerate(y):
                e.append(min(d[j] + (a != b), d[j + 1] + 1, e[-1] + 1))
            d = np.array(e)
        return d[-1]

    assert orderhash.edit_distances(pairs, [1000] * len(pairs)).tolist() == [full(x, y) for x, y in pairs]


def test_block_order_matters(spark):
    a, b = prose(201, 80), prose(202, 80)
    docs = spark.createDataFrame([(1, a + " " + b), (2, b + " " + a)], "doc_id bigint, text string")
    assert orderhash.near_duplicate_groups(docs).select("group_id").distinct().count() == 2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (300, 300)], "a int, b int")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 50, 50: 50, 70: 50, 300: 300}


# mixing

@pytest.mark.parametrize("limits", [{}, {"budget": 3000}, {"target_entropy": 0.9, "max_repeats": 10.0}])
def test_mixing_keeps_weights_and_budget(spark, limits):
    r = random.Random(9)
    docs = spark.createDataFrame(rows() + [row(2000 + i, prose(i, r.randint(1, 60)), "big" if i % 4 else "small") for i in range(300)], SCHEMA)
    plan, weights = mixing.mixing_plan(docs, block_tokens=500, **limits)
    w = {x["source"]: x for x in weights.collect()}
    tokens = Counter()
    for d in docs.collect():
        tokens[d["source"] or ""] += len(words(d["text"])) + 1
    total = sum(tokens.values())
    exponent = w["big"]["exponent"]
    z = sum((n / total) ** exponent for n in tokens.values())
    for s, n in tokens.items():
        assert w[s]["tokens"] == n and abs(w[s]["weight"] - (n / total) ** exponent / z) < 1e-12
    entropy = -sum(x["weight"] * math.log(x["weight"]) for x in w.values())
    repeats = max(x["weight"] / x["share"] for x in w.values()) / min(x["weight"] / x["share"] for x in w.values())
    limit, most = limits.get("target_entropy", mixing.TARGET_ENTROPY), limits.get("max_repeats", mixing.MAX_REPEATS)
    assert entropy <= limit * math.log(len(w)) + 1e-9 and repeats <= most + 1e-9
    assert abs(entropy - limit * math.log(len(w))) < 1e-6 or abs(repeats - most) < 1e-6      # one limit is met
    chosen = plan.collect()
    by_source = defaultdict(list)
    for c in chosen:
        by_source[c["source"]].append(c)
    for s, cs in by_source.items():
        dealt = sum(c["n_tokens"] for c in cs)
        assert dealt >= w[s]["quota"] and dealt - max(c["n_tokens"] for c in cs) < w[s]["quota"] + max(c["n_tokens"] for c in cs)
        if not limits.get("budget"):
            assert {c["epoch"] for c in cs} >= {0}
    for block in {c["block"] for c in chosen}:
        positions = sorted(c["position"] for c in chosen if c["block"] == block)
        assert positions == list(range(1, len(positions) + 1))
    mixed = mixing.mix(docs, block_tokens=500, **limits)
    assert mixed.columns == docs.columns
    if not limits.get("budget"):
        assert {d["doc_id"] for d in mixed.collect()} == {d["doc_id"] for d in docs.collect()}


def test_rows_without_ids_are_mixed_by_the_plan(spark):
    r = random.Random(3)
    texts = [prose(i % 40, 8) if i % 2 else prose(100 + i, r.randint(1, 30)) for i in range(1000)]      # half are repeats
    docs = spark.createDataFrame([row(None if i % 10 else i, t, "big" if i % 8 else "small") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    for budget in (4000, 9000, None):
        plan, weights = mixing.mixing_plan(docs, block_tokens=500, budget=budget)
        assert plan.select("row", "epoch").distinct().count() == plan.count()
        mixed = mixing.mix(docs, block_tokens=500, budget=budget)
        per = lambda df: {x["source"]: x["n"] for x in df.groupBy("source").agg(F.count("*").alias("n")).collect()}
        chosen, made = per(plan), per(mixed)
        quota = {x["source"]: x["quota"] for x in weights.collect()}
        for s in chosen:
            dealt = mixed.where(F.col("source") == s).agg(F.sum(mixing.n_tokens())).head()[0]
            assert quota[s] <= dealt < quota[s] + 31 and abs(chosen[s] - made[s]) <= 40
        # numbers are given anew, so only what does not hang on the order of equal rows is the same
        assert set(chosen) == set(made)


def test_mixing_nothing(spark):
    assert mixing.mixing_plan(no_docs(spark))[0].count() == 0 and mixing.mix(no_docs(spark)).count() == 0


def test_one_row_of_each_group_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([x[:2] for x in near_rows()] + [(None, prose(1, 120)), (15, prose(2, 90) + " more")], "doc_id bigint, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = orderhash.op8(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    left = orderhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    assert sum(r["kept"] for r in got) == len(left)
    assert sorted(str(r["doc_id"]) for r in got if r["kept"]) == sorted(str(r["doc_id"]) for r in left)
    assert {r["text_class"] for r in got if r["doc_id"] is None and r["text_class"] is not None} == {1, 5}


# line runs

def test_long_runs_of_blank_lines(spark):
    n = 60_000
    text = "a b c d e f\n" + "\n" * n + "g h i j k l"
    docs = spark.createDataFrame([(1, text), (2, text + "\nown line"), (3, "alone")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lineruns.drop_repeated_lines(docs).collect()}
    assert got[1]["text"] == text and got[1]["deleted_lines"] == 0 and got[3]["text"] == "alone"
    assert got[2]["text"] == "own line" and got[2]["deleted_lines"] == n + 2


def plain_deleted(docs, least):
    lines = [(d, i, (t.split("\n") if t is not None else [])) for i, (d, t) in enumerate(docs)]
    n_words = {(i, k): len(words(x)) for _, i, ls in lines for k, x in enumerate(ls)}
    seen, gone = {}, set()
    for d, i, ls in sorted(lines, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        for a in range(len(ls)):
            total = 0
            for b in range(a, len(ls)):
                total += n_words[i, b]
                key = tuple(ls[a:b + 1])
                if key in seen and seen[key] != (i, a):
                    if total >= least:
                        gone.update((i, k) for k in range(a, b + 1))
                else:
                    seen.setdefault(key, (i, a))
    return gone


def test_line_runs_equal_all_runs(spark):
    r = random.Random(11)
    pool = [prose(i, r.randint(1, 9)).replace("\n", " ") for i in range(12)] + ["", "}"]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 12)))) for i in range(60)] + [(None, None), (None, pool[0]), (5, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    gone = plain_deleted(docs, 10)
    want = sorted((d is not None, d or 0, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) if t is not None else "null")
                  for i, (d, t) in enumerate(docs))
    got = sorted((x["doc_id"] is not None, x["doc_id"] or 0, x["text"] if x["text"] is not None else "null")
                 for x in lineruns.drop_repeated_lines(frame).collect())
    assert got == want
    assert lineruns.drop_repeated_lines(edge_docs(spark)).columns == [*edge_docs(spark).columns, "deleted_lines"]
    assert lineruns.drop_repeated_lines(edge_docs(spark)).count() == len(rows())
    assert lineruns.drop_repeated_lines(no_docs(spark)).count() == 0


def test_line_runs_of_files_that_are_split_otherwise_later(spark, tmp_path):
    shared = " ".join(["shared"] * 12)
    docs = [(i, "\n".join([shared, f"own line of {i}"] if i % 3 else [f"own line of {i}", shared])) for i in range(24)]
    for i, doc in enumerate(docs):                      # files of different sizes: where they lie together, the largest comes first
        spark.createDataFrame([(*doc, "pad " * i * i)], "doc_id bigint, text string, pad string").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "docs"))
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        spark.conf.set(names[0], "1")
        spark.conf.set(names[1], "0")
        out = lineruns.drop_repeated_lines(spark.read.parquet(str(tmp_path / "docs")))
        spark.conf.set(names[0], "1000")
        spark.conf.set(names[1], str(64 << 20))
        got = {r["doc_id"]: r["text"] for r in out.collect()}
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert got == {i: t if i == 0 else f"own line of {i}" for i, t in docs}


# language model

def test_elias_fano_successors():
    r = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1), (5, 3), (1000, 500), (1000, 10 ** 12), (64, 64), (3000, 2 ** 45)):
        values = np.sort(r.integers(0, top, n)).astype(np.uint64)
        held = EliasFano.of(values)
        wanted = np.concatenate([values, r.integers(0, top * 2, 500).astype(np.uint64)])
        at, there = held.successor(wanted)
        assert (at == np.searchsorted(values, wanted)).all() and (there == np.isin(wanted, values)).all()
        assert not n or (held.get(np.arange(n)) == values).all()


def test_packed_numbers_round_trip():
    r = np.random.default_rng(3)
    for x in (np.zeros(0, np.uint64), r.integers(0, 9, 50), np.sort(r.integers(0, 2 ** 60, 99)), np.array([2 ** 64 - 1, 5], np.uint64)):
        assert (trielm.unpack(trielm.pack(x)) == x.astype(np.uint64)).all()


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 500, "shard_entries": 60}])
def test_trie_scores_equal_plain_counts(spark, sizes):
    given = rows() + [row(3000 + i, prose(i % 17, 30)) for i in range(60)]
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    got = trielm.trie_scores(docs, mod_crc32("doc_id", 7) == 2, order=2, **sizes).collect()
    assert len(got) == len(given)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for d, t, *_ in given:
        if not held(d):
            w = ["\0", *words(t), "\0"]
            one.update(w[1:])
            two.update(zip(w, w[1:]))
    n, v = sum(one.values()), len(one)
    once, twice = sum(x == 1 for x in one.values()), sum(x == 2 for x in one.values())
    d1 = min(max(once / (once + 2 * twice), 0.1), 0.9)
    want = Counter()
    for d, t, *_ in given:
        w = ["\0", *words(t), "\0"]
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w[1:])
        score = 0.0
        for c, x in zip(w, w[1:]):
            code = math.ceil(round(-math.log10(two[c, x] / (one[c] + trielm.MU)) / trielm._STEP, 9)) if two[c, x] else None
            p = (one[x] - d1) / n if one[x] else d1 * v / n
            score += math.log10((10 ** (-code * trielm._STEP) if code is not None else 0) + trielm.MU / (one[c] + trielm.MU) * p)
        want[(d, held(d), len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, round(base, 4), round(score, 3))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 3))
                   for r in got) == want


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 500, "shard_entries": 60}])
@pytest.mark.parametrize("order", [3, 4])
def test_longer_tries_equal_plain_counts_and_score_other_texts(spark, sizes, order):
    given = rows() + [row(3000 + i, prose(i % 17, 30)) for i in range(60)]
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    scores, folder = trielm.train_trie(docs, mod_crc32("doc_id", 7) == 2, order=order, **sizes)
    grams = Counter()
    for d, t, *_ in given:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            w = ["\0", *words(t), "\0"]
            grams.update((x,) for x in w[1:])
            grams.update(tuple(w[i:i + k]) for k in range(2, order + 1) for i in range(len(w) - k + 1))
    one = {g[0]: c for g, c in grams.items() if len(g) == 1}
    n, v = sum(one.values()), len(one)
    once, twice = sum(x == 1 for x in one.values()), sum(x == 2 for x in one.values())
    d1 = min(max(once / (once + 2 * twice), 0.1), 0.9)

    def probability(context, x):
        if not context:
            return (one[x] - d1) / n if x in one else d1 * v / n
        both, c = grams[(*context, x)], grams[context]
        code = math.ceil(round(-math.log10(both / (c + trielm.MU)) / trielm._STEP, 9)) if both else None
        return (10 ** (-code * trielm._STEP) if both else 0) + trielm.MU / (c + trielm.MU) * probability(context[1:], x)

    def plain(t):
        w, score = ["\0", *words(t), "\0"], 0.0
        for i in range(1, len(w)):
            score += math.log10(probability(tuple(w[max(0, i - order + 1):i]), w[i]))
        return round(score, 3)

    got = Counter((r["doc_id"], round(r["score"], 3)) for r in scores.collect())
    assert got == Counter((d, plain(t)) for d, t, *_ in given)
    other = [(i, f"{prose(i % 5, 25)} never seen {prose(40 + i, 9)}") for i in range(9)] + [(None, None), (3, given[0][1])]
    got = trielm.stored_scores(spark.createDataFrame(other, "doc_id bigint, text string"), folder, chunk_bytes=300).collect()
    assert Counter((r["doc_id"], round(r["score"], 3)) for r in got) == Counter((d, plain(t)) for d, t in other)
    assert {r["train_tokens"] for r in got} == {n}


def test_trie_without_training_documents(spark):
    got = trielm.trie_scores(edge_docs(spark), F.lit(True)).collect()
    assert len(got) == len(rows()) and all(r["train_tokens"] == 0 and r["score"] == 0 for r in got)
    assert trielm.trie_scores(no_docs(spark), F.lit(False)).count() == 0


# chat

def test_chat_round_trip_on_awkward_turns(spark):
    r = random.Random(6)
    parts = ["###", "### ", "</turn>", "</turn>\n", "\\", "\\h", "\\e", "\\b", "\\c", ": ", ":", "\n", "a", "é", " ", "assistant", "<", "/turn>"]
    turns = [(c, t, r.choice(["user", "assistant", "", None, "a: b", "x:", "\\c"]), "".join(r.choice(parts) for _ in range(r.randint(0, 7))))
             for c in range(60) for t in range(r.randint(1, 9))]
    turns += [(None, None, None, None), (None, 1, "assistant", None), (1, 0, "user", "again"), (1, 0, "user", "again")]
    given = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_conversations(given).withColumn("parsed", chat.parse_turns(F.col("formatted"))) \
        .withColumn("spans", chat.loss_spans(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, t, role, text in turns:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert len(done) == len(want)
    for x in done:
        expected = [(role, text) for _, _, role, text in sorted(want[x["conv_id"]])]
        assert x["faithful"] and [(p["role"], p["text"]) for p in x["parsed"]] == expected
        back = lambda s: s.replace("\\h", "###").replace("\\e", "</turn>").replace("\\c", ": ").replace("\\b", "\\")
        masked = [back(x["formatted"][s["start"]:s["start"] + s["length"]]) for s in x["spans"]]
        assert masked == [text for role, text in expected if role == "assistant"]
    assert chat.format_conversations(given.limit(0)).count() == 0


def test_plain_turns_are_not_changed(spark):
    given = spark.createDataFrame([(1, 0, "user", "Hi there\n\nfriend: yes"), (1, 1, "assistant", "a < b")], "conv_id int, turn int, role string, text string")
    got = chat.format_conversations(given).head()
    assert got["formatted"] == "### user: Hi there\n\nfriend: yes</turn>\n### assistant: a < b</turn>\n" and got["n_escaped"] == 0


# fixity

def test_audit_finds_exactly_the_damage(spark):
    r = random.Random(8)
    made, at = [], 0
    for i in range(400):
        n = r.randint(60, 900)
        made.append((at, n, hashlib.sha256(str(i).encode()).hexdigest()))
        at += n
    left = spark.createDataFrame(made, "offset bigint, length bigint, digest string")
    damaged = [(o, n, "bad" if i in (3, 250) else d) for i, (o, n, d) in enumerate(made) if i not in (77, 399)] + [(made[10][0] + 1, 5, "new")]
    right = spark.createDataFrame(damaged, "offset bigint, length bigint, digest string")
    got = {(x["offset"], x["finding"]) for x in fixity.fixity_audit(left, right, range_bytes=2048, fanout=4).collect()}
    assert got == {(made[3][0], "altered"), (made[250][0], "altered"), (made[77][0], "missing"), (made[399][0], "missing"), (made[10][0] + 1, "added")}
    assert fixity.fixity_audit(left, left.repartition(3), range_bytes=2048, fanout=4).count() == 0
    assert fixity.fixity_audit(left.limit(0), left.limit(0)).count() == 0
    assert fixity.fixity_audit(left, left.limit(0), range_bytes=2048).count() == 400
    height = fixity.tree_height(at, 2048, 4)
    assert fixity.MerkleTree(left, height, 2048, 4).root() == fixity.MerkleTree(left.repartition(5), height, 2048, 4).root()
    twice = left.unionAll(left.limit(1))
    assert fixity.fixity_audit(left, twice, range_bytes=2048).count() == 1


def test_layout_is_a_running_sum(spark):
    pages = spark.createDataFrame([(3, 5), (1, 7), (None, 2), (2, 1), (2, 1), (9, 4)], "page_id int, length bigint").repartition(3)
    got = fixity.archive_layout(pages, "page_id").collect()
    at = 0
    for x in sorted(got, key=lambda x: x["offset"]):
        assert x["offset"] == at
        at += x["length"]
    assert [x["page_id"] for x in sorted(got, key=lambda x: x["offset"])] == [None, 1, 2, 2, 3, 9]
    assert fixity.archive_layout(pages.limit(0), "page_id").count() == 0


def test_records_of_nulls(spark):
    got = spark.sql("select cast(null as bigint) a, cast(null as string) b").select(fixity.warc_record(F.col("a"), F.col("b"), F.col("b")).alias("r")).head()["r"]
    assert got.startswith("WARC/1.0\r\n") and "Content-Length: 0\r\n\r\n" in got
