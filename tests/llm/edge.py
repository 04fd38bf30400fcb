"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, repetition string, matches int, _node int, _id int, "
          "_rows int, _doc int, _gone int, _source int, _epoch int, _last int, quality_score int")


def words(text: str | None, lower: bool = True) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), "r", 1, 2, 3, 4, 5, 6, 7, 8, 9, 10)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) + r.choice(["", "", "", ".\n", ","]) for _ in range(n))


def rows() -> list:
    base, other = prose(1, 120), prose(2, 90)
    edited = base.split(" ")
    edited[60] = "changed"
    return [
        row(1, base), row(2, base), row(3, " ".join(edited)), row(4, other), row(None, None), row(None, "no id here at all"),
        row(5, ""), row(6, "  \n\t "), row(7, None, None), row(8, "one"), row(9, "two words"), row(10, "ONE"), row(11, "x " * 400),
        row(12, prose(3, 9000)), row(13, other + "\n" + prose(4, 30)), row(14, "é 中 <|endoftext|>  \r\n 's a'b 　."),
        row(15, other, ""), row(15, other, ""), row(16, (prose(5, 30).replace("\n", " ") + "\n") * 2 + prose(6, 80), None),
        row(17, "\n".join([prose(7, 14).replace("\n", " ")] * 3)), row(18, prose(8, 40) + " " + " ".join(words(prose(1, 120))[20:60]))]


def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "lang", "text")


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
