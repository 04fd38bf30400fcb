"""Step templates rendered as native ``concat`` expressions.

The template is parsed once on the driver with ``string.Formatter().parse``;
each literal piece becomes ``lit`` and each field a column. Filled values are
never expanded again (a ``{result}`` inside a prompt stays as text), ``{{`` and
``}}`` are literal braces, and an unknown field is an error, as with
``str.format``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import as_text


def template_fields(template: str) -> list[str]:
    return [f for _, f, _, _ in string.Formatter().parse(template) if f is not None]


def render(template: str, **fields) -> Column:
    """Render ``template.strip()`` with columns (or literal values) for its fields.

    A null value renders as ``None``, like ``str.format`` on Python's ``None``.
    """
    parts: list[Column] = []
    for literal, field, spec, conv in string.Formatter().parse(template.strip()):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if field not in fields:
            raise KeyError(field)
        if spec or conv:
            raise ValueError(f"format spec or conversion not supported in field {field!r}")
        v = fields[field]
        parts.append(as_text(v if isinstance(v, Column) else F.lit(v)))
    if not parts:
        return F.lit("")
    return F.concat(*parts)
