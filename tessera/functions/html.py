"""Reading HTML with native expressions: tags and text nodes, elements by depth, entities.

A page is cut into text nodes and the tags between them. One fold over the tags counts the depth of the elements that are
dropped or selected, of any nesting, so an element ends where a parser would end it if its tags are balanced; one that is
never closed ends with the page. Classes are compared as whole, space-separated tokens, in any quoting.
"""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a tag: its sign, name and attributes, where quoted values may hold ``>``
_TAG = r"""<({sign}[/!?]?)({name}[A-Za-z][A-Za-z0-9:-]*+)({rest}[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+)>"""
TAG_PARTS = _TAG.format(sign="", name="", rest="")
TAG = _TAG.format(sign="?:", name="?:", rest="?:")
#: comments, and elements whose content is no text
NON_TEXT = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_CLASS = r"""(?is)(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: elements without content, fixed by HTML
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NODE_SPACE = " \t\r\n\f\x0b\u00a0"


def _named_entities() -> str:
    """All named character references, as the standard library lists them."""
    return json.dumps({name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")})


def decode_entities(text: Column) -> Column:
    """Numeric and named character references of a text, each read once; unknown ones stay."""
    names = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1))
    between = F.split(text, _ENTITY)
    named = F.from_json(F.lit(_named_entities()), "map<string,string>")

    def read(name: Column, before: Column) -> Column:
        number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 8), 16, 10)) \
            .otherwise(F.substring(name, 2, 8)).cast("int")
        sound = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        point = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        value = F.when(F.startswith(name, F.lit("#")), point).otherwise(F.element_at(named, name))
        return F.concat(before, F.coalesce(value, F.concat(F.lit("&"), name, F.lit(";"))))

    decoded = F.concat(F.array_join(F.zip_with(names, F.slice(between, F.lit(1), F.size(names)), read), ""), F.element_at(between, -1))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tag(t: Column, dropped_tags, dropped_classes, article: str, main_tag: str, main_class: str) -> Column:
    """What the fold needs of a tag: its number, name, step (1 opens, -1 closes, 0 neither), and whether it starts a region."""
    name = t["name"]
    opens = (t["sign"] == "") & ~F.endswith(t["rest"], F.lit("/")) & ~name.isin(*VOID)
    given = F.when(opens & _may_have(t["rest"], (*dropped_classes, main_class)), F.btrim(F.regexp_extract(t["rest"], _CLASS, 1), F.lit("\"'")))

    def struct(classes: Column) -> Column:
        has = lambda *wanted: F.coalesce(F.arrays_overlap(classes, F.array(*map(F.lit, wanted))), F.lit(False))
        return F.struct(t["i"].alias("i"), name.alias("name"), F.when(t["sign"] == "/", -1).when(opens, 1).otherwise(0).alias("step"),
                        (opens & (name.isin(*dropped_tags) | has(*dropped_classes))).alias("drop"),
                        (opens & (name == article)).alias("article"), (opens & (name == main_tag) & has(main_class)).alias("main"))

    return _bind(F.split(given, r"\s+"), struct)


def _may_have(attributes: Column, names) -> Column:
    """A quick look whether any of the names occurs at all."""
    return reduce(lambda a, b: a | b, [F.contains(attributes, F.lit(n)) for n in names])


_STATE = ("struct<name:string,depth:int,start:int,dropped:array<struct<a:int,b:int>>,"
          "a_depth:int,a_start:int,a_end:int,m_depth:int,m_start:int,m_end:int>")


def _follow(s: Column, t: Column, key: str, opens: Column, name: str) -> list[Column]:
    """depth, start and end of the first element that ``opens`` marks; ``name`` tells its inner and closing tags."""
    depth, start, end = s[f"{key}_depth"], s[f"{key}_start"], s[f"{key}_end"]
    begin = (depth == 0) & start.isNull() & opens
    inner = (depth > 0) & (t["name"] == name)
    next_ = F.when(begin, 1).when(inner, depth + t["step"]).otherwise(depth)
    return [next_.alias(f"{key}_depth"), F.when(begin, t["i"]).otherwise(start).alias(f"{key}_start"),
            F.when(inner & (next_ == 0), t["i"]).otherwise(end).alias(f"{key}_end")]


def focus_nodes(page: Column, dropped_tags, dropped_classes, article: str, main_tag: str, main_class: str) -> Column:
    """The text nodes of the first ``article``, else of the first ``main_tag`` of ``main_class``, else of the page, without the
    dropped elements."""
    clean = F.regexp_replace(page, NON_TEXT, "")
    texts = F.split(clean, TAG)
    parts = [F.regexp_extract_all(clean, F.lit(TAG_PARTS), F.lit(i)) for i in (1, 2, 3)]
    none = F.lit(None).cast("int")
    zero = F.struct(F.lit("").alias("name"), F.lit(0).alias("depth"), F.lit(0).alias("start"),
                    F.array().cast("array<struct<a:int,b:int>>").alias("dropped"), F.lit(0).alias("a_depth"), none.alias("a_start"),
                    none.alias("a_end"), F.lit(0).alias("m_depth"), none.alias("m_start"), none.alias("m_end")).cast(_STATE)

    def step(s: Column, t: Column) -> Column:
        inside = s["depth"] > 0
        begin = ~inside & t["drop"]
        depth = F.when(begin, 1).when(inside & (t["name"] == s["name"]), s["depth"] + t["step"]).otherwise(s["depth"])
        ended = inside & (depth == 0)
        region = F.struct((s["start"] + 1).alias("a"), t["i"].alias("b"))
        outside = ~inside & ~begin                         # what a dropped element holds is not looked at
        kept = [F.when(outside, new).otherwise(s[old]).alias(old)
                for key, name in (("a", article), ("m", main_tag))
                for new, old in zip(_follow(s, t, key, t["article" if key == "a" else "main"], name),
                                    (f"{key}_depth", f"{key}_start", f"{key}_end"))]
        return F.struct(F.when(begin, t["name"]).otherwise(s["name"]).alias("name"), depth.alias("depth"),
                        F.when(begin, t["i"]).otherwise(s["start"]).alias("start"),
                        F.when(ended, F.array_append(s["dropped"], region)).otherwise(s["dropped"]).alias("dropped"), *kept).cast(_STATE)

    def kept(page: Column) -> Column:
        texts, last = page["texts"], F.size(page["texts"]) - 1
        # only tags of names that can begin or end a region are followed
        marked = F.filter(F.transform(page["names"], lambda n, i: F.when(_may_have(page["rests"][i], dropped_classes), n)), lambda n: n.isNotNull())
        names = F.array_union(F.array(*map(F.lit, sorted({*dropped_tags, article, main_tag}))), F.transform(marked, F.lower))

        def follow(wanted: Column) -> Column:
            tags = F.transform(page["names"], lambda n, i: F.struct(i.alias("i"), F.lower(n).alias("name"), page["signs"][i].alias("sign"),
                                                                    page["rests"][i].alias("rest")))
            return F.transform(F.filter(tags, lambda t: F.array_contains(wanted, t["name"])),
                               lambda t: _tag(t, dropped_tags, dropped_classes, article, main_tag, main_class))

        def finish(s: Column) -> Column:
            open_ = F.array_append(s["dropped"], F.struct((s["start"] + 1).alias("a"), last.alias("b")))
            first = F.coalesce(s["a_start"], s["m_start"], F.lit(-1)) + 1
            end = F.when(s["a_start"].isNotNull(), s["a_end"]).when(s["m_start"].isNotNull(), s["m_end"])
            return F.struct(F.when(s["depth"] > 0, open_).otherwise(s["dropped"]).alias("dropped"), first.alias("first"),
                            F.coalesce(end, last).alias("last"))

        return _bind(F.aggregate(_bind(names, follow), zero, step, finish), lambda f: F.filter(
            texts, lambda _, i: (i >= f["first"]) & (i <= f["last"]) & ~F.exists(f["dropped"], lambda r: (i >= r["a"]) & (i <= r["b"]))))

    return _bind(F.struct(texts.alias("texts"), *[p.alias(n) for p, n in zip(parts, ("signs", "names", "rests"))]), kept)


def joined_text(nodes: Column) -> Column:
    """The nodes, decoded and stripped, joined with nothing."""
    return F.array_join(F.transform(nodes, lambda n: F.btrim(decode_entities(n), F.lit(NODE_SPACE))), "")
