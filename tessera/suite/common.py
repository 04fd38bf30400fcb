"""Shared pieces of the fixture queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import read_table


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# DuckDB expression templates mirroring tessera.functions.text ---------------
WS = r"[ \t\r\n\f\x0b]"


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def d_sentences(x: str) -> str:
    marked = f"regexp_replace({d_strip(x)}, '([.!?])[ \\t\\r\\n\\f]+', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: length(s) > 0)"


def d_pack(sents: str, max_chars: int = 1024) -> str:
    step = (
        f"lambda acc, s: CASE WHEN length(acc.cur) + length(s) > {max_chars} "
        "THEN {'out': list_append(acc.out, acc.cur), 'cur': s || ' '} "
        "ELSE {'out': acc.out, 'cur': acc.cur || s || ' '} END"
    )
    folded = f"list_reduce({sents}, {step}, {{'out': []::VARCHAR[], 'cur': ''}})"
    return f"CASE WHEN len({sents}) > 0 THEN list_append(({folded}).out, ({folded}).cur) ELSE []::VARCHAR[] END"


def d_title(src: str = "source", doc_id: str = "doc_id") -> str:
    return f"({src} || '/' || CAST({doc_id} AS VARCHAR) || '.txt')"


def d_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) > 0)"


def d_bucket(tok: str, dim: int = 384) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 8))::BIGINT % {dim})"


def d_sqdist(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), "
            f"lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)), "
            f"lambda s, x: s + x, 0.0::DOUBLE)")
