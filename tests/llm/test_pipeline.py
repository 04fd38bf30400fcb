"""The corpus pipeline, stage by stage, against plain versions on the small driver tables and on awkward rows."""

import zlib

import numpy as np
import pytest
from conftest import SF
from edge import edge_docs, no_docs, rows
from test_group_operators import plain_groups
from test_text_operators import alnum, plain_repeats

import corpus_pipeline as P
from tessera.llm import repeats, tokenfiles
from tessera.llm.common import pin, table


def plain_kept(text):
    c = plain_repeats(text)
    n = max(c["n_words"], 1)
    return (c["n_words"] >= 20 and 100 * c["n_repeat_words"] <= 30 * c["n_words"] and c["covered_words"] / n <= repeats.MAX_COVERED
            and c["longest_repeat"] / n <= repeats.MAX_LONGEST)


def test_stages_equal_plain_versions(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    given = docs.collect()
    ruled = [d for d in given if plain_kept(d["text"])]
    groups = plain_groups([d["text"] for d in ruled])
    least = {}
    for d in ruled:
        g = groups[d["text"]]
        least[g] = min(least.get(g, d["doc_id"]), d["doc_id"])
    single = [d for d in ruled if least[groups[d["text"]]] == d["doc_id"]]
    windows = set()
    for b in table(spark, SF, "benchmark").collect():
        w = alnum(b["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    spoken = {d["doc_id"]: alnum(d["text"]) for d in single}
    clean = [d for d in single if not any(tuple(w[i:i + k]) in windows for w in [spoken[d["doc_id"]]] for k in sizes for i in range(len(w) - k + 1))]
    frame = docs
    for (name, stage), want in zip(P.STAGES[:3], (ruled, single, clean)):
        frame = pin(stage(spark, frame, SF), name)
        assert frame.columns == docs.columns
        assert sorted(frame.collect()) == sorted(want), name
    mixed = pin(P.STAGES[3][1](spark, frame, SF), "mixed")
    assert mixed.columns == docs.columns and set(mixed.collect()) == set(clean)
    whole = Tokenizer.from_str(tokenfiles.public_tokenizer())
    start = 0
    got = sorted(P.STAGES[4][1](spark, mixed, SF).collect(), key=lambda r: r["start"])
    for r, d in zip(got, sorted(mixed.collect(), key=lambda d: d["doc_id"]), strict=True):
        ids = [*whole.encode(d["text"], add_special_tokens=False).ids, 0]
        assert tuple(r) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("stage", P.STAGES, ids=lambda s: s[0])
def test_stages_take_awkward_and_no_rows(spark, stage):
    assert stage[1](spark, no_docs(spark), SF).count() == 0
    done = stage[1](spark, edge_docs(spark), SF)
    assert 0 < done.count() <= 2 * len(rows())
    if stage[0] != "token_files":
        assert done.columns == edge_docs(spark).columns
