"""Quality rules on repetition: per text, a suffix array over its words and the LCP intervals of its repeats.

A repeat is a maximal word sequence found twice or more in one text; the suffix at a word has the longest common prefix
``l`` with a neighbour in the suffix array, so the words [p, p + l) belong to a repeat. The union of the spans of at least
``min_repeat`` words, over the number of words, is the covered fraction.

Texts are never joined or shuffled: the rule is one Arrow function over the text column, in slices of bounded bytes (a
longer text is one slice). Null and empty texts have no words; equal rows get equal results; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import free_name
from tessera.llm.suffixes import longest_repeats

WINDOW = 8               # words of the base rule's windows
MIN_WORDS = 20           # base rule: fewer words fail
MAX_WINDOW_PERCENT = 30  # base rule: percent of words in repeated windows
MIN_REPEAT = 4           # words of the shortest repeat that counts as covered
MAX_COVERED = 0.35       # the method's limits: covered fraction, and longest repeat over number of words
MAX_LONGEST = 0.20

_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
_SYMBOLS = W.byte_set(b"#*$%&|<>")
_BLANK = " \t\n\v\f\r"


def _covered(best: np.ndarray, rows: np.ndarray, n_rows: int, least: int) -> np.ndarray:
    """Words of each row in the union of the spans [p, p + best[p]) of at least ``least`` words."""
    at = np.flatnonzero(best >= least)
    change = np.zeros(len(best) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + best[at], -1)
    return W.count_by_row(rows[np.cumsum(change[:-1]) > 0], n_rows)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    for row in range(len(out)):
        lines = [x for x in raw[offsets[row]:offsets[row + 1]].split(b"\n") if x.strip(_BLANK.encode())]
        out[row] = len(lines) - len(set(lines))
    return out


def measure(texts: pa.Array) -> pa.StructArray:
    """The counts of ``_FIELDS`` for every text of an Arrow array."""
    parts = []
    for _, data, offsets in W.slices(texts):
        n_rows = len(offsets) - 1
        starts, ends, rows = W.spans(data, offsets, W.NOT_SPACE)
        n_words = W.count_by_row(rows, n_rows)
        word_ends = np.cumsum(n_words)
        # a word is a symbol of its own in every text, so no suffix ties with one of another text
        symbols = W.mix(W.keys(data, starts, ends) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        best = longest_repeats(symbols, word_ends[rows]) if len(rows) else np.zeros(0, np.int64)
        longest = np.zeros(n_rows, np.int64)
        np.maximum.at(longest, rows, best)
        chars = W.sum_by_row(W.NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
        parts.append([n_words, chars, W.sum_by_row(_SYMBOLS[data], offsets), _repeated_lines(data, offsets),
                      _covered(best, rows, n_rows, WINDOW), _covered(best, rows, n_rows, MIN_REPEAT), longest])
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(len(_FIELDS))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_FIELDS))


def repeat_stats(text: Column) -> Column:
    """A struct of ``_FIELDS`` for a text column."""
    @F.arrow_udf("struct<" + ",".join(f"{f}:bigint" for f in _FIELDS) + ">")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield measure(texts)

    return stats.asNondeterministic()(text)   # not evaluated again when a filter above is pushed down


def repetition_rules(docs: DataFrame, text: str = "text", into: str = "repetition", max_covered: float = MAX_COVERED,
                     max_longest: float = MAX_LONGEST) -> DataFrame:
    """``docs`` with a struct column ``into`` (underscores are put before a name that is taken; see ``free_name``).

    Its fields are the counts, ``covered`` (fraction of words in repeats), ``longest`` (longest repeat over the number of
    words), ``base_failed`` and ``kept``. Texts without words fail the base rule.
    """
    into = free_name(docs, into)
    s = F.col(into)
    measured = docs.withColumn(into, repeat_stats(F.col(text).cast("string")))
    share = lambda part: F.when(s.n_words > 0, part / s.n_words).otherwise(F.lit(0.0))
    base_failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_WINDOW_PERCENT * s.n_words)
    kept = ~base_failed & (share(s.covered_words) <= max_covered) & (share(s.longest_repeat) <= max_longest)
    return measured.withColumn(into, s.withField("covered", share(s.covered_words))
                               .withField("longest", share(s.longest_repeat))
                               .withField("base_failed", base_failed).withField("kept", kept))


def op10(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    ruled = repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ruled.select("doc_id", *[F.col(f"repetition.{f}").alias(f) for f in _FIELDS if f != "longest_repeat"],
                        "repetition.base_failed", "repetition.kept")


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"


def _windows_sql(k: int) -> str:
    return f"""SELECT doc_id, i, list_slice(words, i, i + {k - 1}) AS g
               FROM (SELECT doc_id, words, unnest(range(1, len(words) - {k - 2})) AS i FROM w WHERE len(words) >= {k})"""


#: A longest repeat over the limit alone covers more than that share, so only such texts need its windows looked at.
OP10_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_words_sql('text')} AS words FROM documents),
same AS (
  SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS c FROM ({_windows_sql(MIN_REPEAT)})),
same8 AS (SELECT doc_id, i, g, count(*) OVER (PARTITION BY doc_id, g) AS c FROM ({_windows_sql(WINDOW)})),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS covered_words
            FROM (SELECT doc_id, i, unnest(range(0, {MIN_REPEAT})) AS d FROM same WHERE c > 1) GROUP BY doc_id),
covered8 AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words
             FROM (SELECT doc_id, i, unnest(range(0, {WINDOW})) AS d FROM same8 WHERE c > 1) GROUP BY doc_id),
long_repeat AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, i, list_slice(words, i, i + k - 1) AS g
    FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i
          FROM (SELECT *, cast(floor({MAX_LONGEST} * len(words)) AS BIGINT) + 1 AS k
                FROM w JOIN covered USING (doc_id)
                WHERE covered_words > {MAX_LONGEST} * len(words) AND covered_words <= {MAX_COVERED} * len(words))))
  GROUP BY doc_id, g HAVING count(*) > 1),
counts AS (
  SELECT w.doc_id, cast(len(words) AS BIGINT) AS n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    cast(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    cast(coalesce(covered_words, 0) AS BIGINT) AS covered_words,
    long_repeat.doc_id IS NOT NULL AS long_repeat
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM w) w
  LEFT JOIN covered USING (doc_id) LEFT JOIN covered8 USING (doc_id) LEFT JOIN long_repeat USING (doc_id))
SELECT * EXCLUDE (long_repeat), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_WINDOW_PERCENT} * n_words)
  AND covered_words / greatest(n_words, 1) <= {MAX_COVERED} AND NOT long_repeat AS kept
FROM counts
"""
