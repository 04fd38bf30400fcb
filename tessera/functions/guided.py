"""Guided output checks: does a model's text follow a JSON schema's shape?

The schema is compiled once on the driver into one regular expression (the
language has no recursion, so it is regular) and applied with ``rlike`` on the
column; no per-row Python. Rules:

* every property is required and appears in order: the given ``prop_order``
  rank first, then the name;
* at most one space after each token (``" "?``);
* primitives ``boolean``, ``number``, ``integer``, ``string``, ``null``;
  composites ``object`` (with properties), ``array`` (with items),
  ``oneOf``/``anyOf``, ``const``, ``enum``. Anything else is refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_valid_json

# Fixed values that must equal the reference's for right results.
SPACE = "[ ]?"
PRIMITIVES = {
    "boolean": "(?:true|false)",
    "number": r"-?(?:[0-9]|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?",
    "integer": r"-?(?:[0-9]|[1-9][0-9]*)",
    "string": r'"(?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"',
    "null": "null",
}
NOT_JSON = "Not a valid Json"
# Java's regex engine recurses once per repetition of a group, which overflows
# the stack on long texts; possessive runs make it loop instead. The string and
# list languages are unambiguous, so possessive and plain forms match the same
# texts. RE2 (the DuckDB twin) has no possessive quantifiers and needs none.
JAVA_STRING = r'"(?:[^"\\]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'

# The loose style of two shipped grammars: any run of space/tab/newline, strings
# without escapes, keys written together with their colon.
LOOSE_WS = r"[ \t\n]*"
LOOSE_STRING = r'"[^"]*"'
LOOSE_NUMBER = r"[0-9]+\.?[0-9]*"


class SchemaError(ValueError):
    pass


# A schema is read once into nodes; one renderer makes the regex, another the Spark type ------------------------------
@dataclass(frozen=True)
class Plain:
    """A primitive value of the named kind."""

    kind: str


@dataclass(frozen=True)
class OneOfTexts:
    """One of some fixed JSON texts."""

    texts: tuple[str, ...]


@dataclass(frozen=True)
class Either:
    branches: tuple


@dataclass(frozen=True)
class Listed:
    element: object


@dataclass(frozen=True)
class Fields:
    """All members in writing order: (name, node)."""

    members: tuple


def _read_fields(schema, rank):
    given = rank or {}
    places = {name: (name not in given, given.get(name, 0), name) for name in schema["properties"]}   # ranked ones first
    return Fields(tuple((name, read_schema(schema["properties"][name], rank)) for name in sorted(places, key=places.get)))


#: keyword that decides the node, the ``type`` it needs (None: any), and how to read it; the first that fits is taken
_RULES = (
    ("oneOf", None, lambda s, rank: Either(tuple(read_schema(x, rank) for x in s["oneOf"]))),
    ("anyOf", None, lambda s, rank: Either(tuple(read_schema(x, rank) for x in s["anyOf"]))),
    ("const", None, lambda s, rank: OneOfTexts((json.dumps(s["const"]),))),
    ("enum", None, lambda s, rank: OneOfTexts(tuple(map(json.dumps, s["enum"])))),
    ("properties", "object", _read_fields),
    ("items", "array", lambda s, rank: Listed(read_schema(s["items"], rank))),
)


def read_schema(schema, rank: dict | None = None):
    """The node of a JSON schema, given as text or parsed; ``rank`` orders the properties it names before all others."""
    if isinstance(schema, str):
        try:
            schema = json.loads(schema)
        except ValueError as problem:
            raise SchemaError(NOT_JSON) from problem
    if isinstance(schema, dict):
        for keyword, kind, reader in _RULES:
            if keyword in schema and kind in (None, schema.get("type")):
                return reader(schema, rank)
        if schema.get("type") in PRIMITIVES:
            return Plain(schema["type"])
    raise SchemaError(f"no rule reads this schema: {schema!r}")


_META = set("\\.^$|?*+()[]{}")


def _esc(text: str) -> str:
    """Escape regex metacharacters only (portable between Java and RE2)."""
    return "".join("\\" + ch if ch in _META else ch for ch in text)


def _group(alternatives) -> str:
    return "(?:" + "|".join(alternatives) + ")"


class RegexRenderer:
    """The regular expression of a node; ``java`` uses possessive runs, which its engine needs on long texts."""

    def __init__(self, dialect: str = "java"):
        self.many = "*+" if dialect == "java" else "*"
        # a possessive run keeps the alternative it took first: it must be one that ends at a comma or at the list's end
        self.ended = r"(?=[,\]])" if dialect == "java" else ""
        self.primitives = PRIMITIVES | ({"string": JAVA_STRING} if dialect == "java" else {})

    def render(self, node) -> str:
        return getattr(self, type(node).__name__.lower())(node)

    def mark(self, sign: str) -> str:
        return _esc(sign) + SPACE

    def plain(self, node: Plain) -> str:
        return _group([self.primitives[node.kind]]) + SPACE

    def oneoftexts(self, node: OneOfTexts) -> str:
        return _group(map(_esc, node.texts))

    def either(self, node: Either) -> str:
        return _group(map(self.render, node.branches))

    def listed(self, node: Listed) -> str:
        element = self.render(node.element)
        further = _group([self.mark(",") + element + self.ended]) + self.many
        return self.mark("[") + _group([element + further]) + "?" + self.mark("]")

    def fields(self, node: Fields) -> str:
        members = [self.mark(json.dumps(name)) + self.mark(":") + self.render(value) for name, value in node.members]
        return self.mark("{") + self.mark(",").join(members) + self.mark("}")


def schema_regex(schema, prop_order: dict | None = None, dialect: str = "java") -> str:
    """Regex for texts that follow ``schema``; ``dialect`` is ``java`` (Spark) or ``re2``."""
    return RegexRenderer(dialect).render(read_schema(schema, prop_order))


def loose_object_regex(fields: list[tuple[str, str]], dialect: str = "java") -> str:
    """Regex of the loose style: ``{ws "key": ws value , ws ... }``.

    ``fields`` is a list of ``(name, kind)`` with kind ``string``,
    ``stringlist`` or ``number``.
    """
    kinds = {
        "string": LOOSE_STRING,
        "number": LOOSE_NUMBER,
        "stringlist": (r"(?:\[" + LOOSE_WS + r"\]|\[" + LOOSE_WS + LOOSE_STRING + "(?:," + LOOSE_WS
                       + LOOSE_STRING + (")*+" if dialect == "java" else ")*") + LOOSE_WS + r"\])"),
    }
    body = r"\{" + LOOSE_WS
    for i, (name, kind) in enumerate(fields):
        if i:
            body += "," + LOOSE_WS
        body += _esc(json.dumps(name) + ":") + LOOSE_WS + kinds[kind]
    return body + r"\}"


def full_match_pattern(regex: str) -> str:
    """Anchor for Spark: ``\\z`` and not ``$`` (``$`` accepts a trailing newline in Java)."""
    return "^(?:" + regex + r")\z"


def conforms(c, schema=None, prop_order: dict | None = None, regex: str | None = None) -> Column:
    """The text follows the schema (null text does not)."""
    col = F.col(c) if isinstance(c, str) else c
    rx = regex if regex is not None else schema_regex(schema, prop_order)
    return F.coalesce(col.rlike(full_match_pattern(rx)), F.lit(False))


# J2 ------------------------------------------------------------------------
_SPARK_TYPES = {"boolean": "boolean", "integer": "bigint", "number": "double"}


def spark_type(node) -> str:
    """The Spark type of a node; fixed texts, strings and nulls are text, alternatives a branch number and a variant."""
    match node:
        case Fields(members):
            return "struct<" + ", ".join(f"`{name}`: {spark_type(value)}" for name, value in members) + ">"
        case Listed(element):
            return f"array<{spark_type(element)}>"
        case Plain(kind):
            return _SPARK_TYPES.get(kind, "string")
        case Either():
            return "struct<branch: int, value: variant>"
    return "string"


def schema_ddl(schema, prop_order: dict | None = None) -> str:
    """Spark type of a schema."""
    return spark_type(read_schema(schema, prop_order))


def has_alternatives(node) -> bool:
    match node:
        case Either():
            return True
        case Listed(element):
            return has_alternatives(element)
        case Fields(members):
            return any(has_alternatives(value) for _, value in members)
    return False


def _value(text: Column, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$", kind)


def _branch(node: Either, text: Column) -> Column:
    """The number of the first alternative whose regex the text follows."""
    found = F.lit(None).cast("int")
    for i, branch in reversed(list(enumerate(node.branches))):
        found = F.when(text.rlike(full_match_pattern(RegexRenderer().render(branch))), F.lit(i)).otherwise(found)
    return found


def _typed(node, text: Column) -> Column:
    """The value of a text that follows the node; parts are cut out of the text itself, so nothing is written anew."""
    render = RegexRenderer()
    match node:
        case Either():
            return F.struct(_branch(node, text).alias("branch"), F.try_parse_json(text).alias("value"))
        case Fields(members):
            # one capturing group for each member; all other groups of the pattern do not capture
            parts = [render.mark(json.dumps(name)) + render.mark(":") + "(" + render.render(value) + ")" for name, value in members]
            whole = full_match_pattern(render.mark("{") + render.mark(",").join(parts) + render.mark("}"))
            return F.struct(*[_typed(value, F.regexp_extract(text, whole, i)).alias(name) for i, (name, value) in enumerate(members, 1)])
        case Listed(element):
            inner = F.regexp_replace(text, r"^\[[ ]?|\][ ]?\z", "")
            one = "(" + render.render(element) + r")(?:,[ ]?|\z)"
            return F.transform(F.regexp_extract_all(inner, F.lit(one), F.lit(1)), lambda t: _typed(element, t))
        case Plain(kind):
            return F.lit(None).cast("string") if kind == "null" else _value(text, spark_type(node))
    return F.coalesce(_value(text, "string"), F.trim(text))       # fixed texts: a string's characters, else the JSON text


def parse_guided(df: DataFrame, c: str, schema, prop_order: dict | None = None, into: str = "parsed") -> DataFrame:
    """Typed parse of the texts that conform; others get null.

    A value with alternatives becomes a struct of ``branch``, the number of the first alternative that the text follows,
    and ``value``, a variant; ``alternative`` gives it the branch's type.
    """
    node = read_schema(schema, prop_order)
    parsed = _typed(node, F.col(c)) if has_alternatives(node) else F.from_json(F.col(c), spark_type(node))
    return df.withColumn(into, F.when(conforms(c, schema, prop_order), parsed))


def alternative(parsed: Column, schema, branch: int) -> Column:
    """The value of a parsed alternative as the type of its branch, null where another branch was taken. ``schema`` is the
    part of the schema that lists the alternatives."""
    node = read_schema(schema)
    kind = spark_type(node.branches[branch])
    return F.when(parsed["branch"] == branch, F.try_variant_get(parsed["value"], "$", kind))


# J3 ------------------------------------------------------------------------
def _obj(**props):
    return {"type": "object", "properties": props}


S, N, I, B = ({"type": "string"}, {"type": "number"}, {"type": "integer"}, {"type": "boolean"})

# Fixed values that must equal the reference's for right results: the shipped formats.
NAMED_SCHEMAS = {
    "urllist": _obj(Url_1=S, Url_2=S, Url_3=S),
    "singleexpression": _obj(df=S),
    "python_script": _obj(body=S, function_name=S, return_type=S,
                          parameters={"type": "array", "items": _obj(default=S, name=S, type=S)}),
    "student": _obj(name=S, age=N, isStudent=B),
    "cars": _obj(age=N, courses={"type": "array", "items": S}, is_student=B, name=S),
    "example1": _obj(age=I, is_active=B, name=S),
}
NAMED_LOOSE = {
    "news": [("title", "string"), ("subtitle", "string"), ("author", "string"), ("date", "string"),
             ("content", "string"), ("tags", "stringlist"), ("references", "stringlist")],
    "delivery": [("tracking_number", "string"), ("status", "string"), ("weight", "string"),
                 ("submitted_ts", "string")],
}


def named_regex(name: str, dialect: str = "java") -> str:
    """Regex of a shipped format by name."""
    if name in NAMED_SCHEMAS:
        return schema_regex(NAMED_SCHEMAS[name], dialect=dialect)
    if name in NAMED_LOOSE:
        return loose_object_regex(NAMED_LOOSE[name], dialect)
    raise KeyError(name)


# J4 ------------------------------------------------------------------------
def conformance_stats(df: DataFrame, c: str, schema=None, by=(), regex: str | None = None) -> DataFrame:
    """Per group, texts that are valid JSON, that conform, and that are neither."""
    ok = conforms(c, schema, regex=regex)
    valid = is_valid_json(c)
    return df.groupBy(*by).agg(
        F.count_if(valid).alias("n_valid_json"),
        F.count_if(ok).alias("n_conforming"),
        F.count_if(~valid & ~ok).alias("n_neither"),
        F.count("*").alias("n"),
    )
