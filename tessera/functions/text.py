"""Scalar text functions (Column -> Column), all native Catalyst expressions.

Nothing here leaves the JVM: each function builds an expression tree that runs
inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
TOKEN_CHARS = 3.5
TOO_LONG_MSG = "Error: The message is too long and exceeds the model's token limit."
NO_STOP_MSG = "Error: String does not finish with [stop]."
STOP_SUFFIX = "[stop]"
TRUNCATE_MARKER = "\n[Content truncated due to length]"
DEFAULT_USER_TAG = "[User]: "
DEFAULT_ASSISTANT_TAG = "[Assistant]: "
COMPLETION_STOP = "[User]:"
NONE_TEXT = "None"

# Whitespace as Python's str.strip() sees it for the texts we handle.
WS = r"[ \t\r\n\f\x0b]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace."""
    return F.regexp_replace(_c(c), rf"^{WS}+|{WS}+$", "")


def count_tokens(c) -> Column:
    """B1: token estimate, characters / 3.5."""
    return F.length(_c(c)) / F.lit(TOKEN_CHARS)


def budget_gate(c, context_size: int, max_length: int, otherwise=None) -> Column:
    """B2: fixed error text when the prompt exceeds ``context_size - max_length`` tokens."""
    limit = context_size - max_length
    base = _c(c) if otherwise is None else _c(otherwise)
    return F.when(count_tokens(c) > F.lit(float(limit)), F.lit(TOO_LONG_MSG)).otherwise(base)


def tag_prompt(c, user_tag: str = DEFAULT_USER_TAG, assistant_tag: str = DEFAULT_ASSISTANT_TAG) -> Column:
    """Role-tagged prompt."""
    return F.concat(F.lit(user_tag), _c(c), F.lit(assistant_tag))


def is_valid_json(c) -> Column:
    """The whole text is one JSON value (null and empty text are not JSON).

    ``try_parse_json`` alone accepts a leading value followed by other text
    (``"k": 1}``), so the text must also parse inside an array and as the value
    of an object member; a bare ``null`` is the one value the member check
    returns as SQL null. Repeated keys and ``NaN`` are rejected (Python accepts
    them; see README).
    """
    col = _c(c)
    member = F.get_json_object(F.concat(F.lit('{"x":'), col, F.lit("}")), "$.x")
    ok = (F.try_parse_json(col).isNotNull()
          & F.try_parse_json(F.concat(F.lit("["), col, F.lit("]"))).isNotNull()
          & (member.isNotNull() | (strip_ws(col) == F.lit("null"))))
    return F.coalesce(ok, F.lit(False))


# scheme ":" "//" host; the host part must be non-empty
URL_PATTERN = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"


def is_valid_url(c) -> Column:
    """Scheme and host both non-empty."""
    return F.coalesce(_c(c).rlike(URL_PATTERN), F.lit(False))


def content_hash(c) -> Column:
    """Hex md5 of the UTF-8 text."""
    return F.md5(_c(c).cast("binary"))


def unwrap(c, key: str = "df") -> Column:
    """A JSON object's field (missing -> empty text), else the stripped raw text."""
    return F.when(is_valid_json(c), F.coalesce(F.get_json_object(_c(c), f"$.{key}"), F.lit(""))).otherwise(
        strip_ws(c)
    )


def strip_list(c, guarded: bool = True) -> Column:
    """Drop two characters at each end (only for ``['...']`` when guarded)."""
    col = _c(c)
    inner = F.substring(col, F.lit(3), F.greatest(F.length(col) - 4, F.lit(0)))
    if not guarded:
        return inner
    return F.when(col.startswith("['") & col.endswith("']") & (F.length(col) >= 4), inner).otherwise(col)


def remove_suffix(c, suffix: str = STOP_SUFFIX, error: str = NO_STOP_MSG) -> Column:
    """Strip a required suffix, else the fixed error text."""
    col = _c(c)
    return F.when(col.endswith(suffix), F.substring(col, F.lit(1), F.length(col) - len(suffix))).otherwise(F.lit(error))


def flatten_ids(c, depth: int = 1) -> Column:
    """Flatten ``depth`` levels of nested id arrays."""
    col = _c(c)
    for _ in range(depth):
        col = F.flatten(col)
    return col


def truncate(c, n: int, marker: str = TRUNCATE_MARKER) -> Column:
    """Over ``n`` characters -> first ``n`` plus the marker."""
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(marker))).otherwise(col)


def cut_completion(c, stop: str = COMPLETION_STOP, max_tokens: int | None = None) -> Column:
    """Cut at the first stop text, then keep at most ``max_tokens`` words."""
    col = F.substring_index(_c(c), stop, 1)
    if max_tokens is not None:
        col = F.array_join(F.slice(F.split(col, " "), 1, max_tokens), " ")
    return col


def as_text(c) -> Column:
    """Coerce to text, null -> ``None``."""
    return F.coalesce(_c(c).cast("string"), F.lit(NONE_TEXT))


# D1 ------------------------------------------------------------------------


SENTENCE_SPLIT = r"(?<=[.!?])[ \t\r\n\f]+"


def sentences(c) -> Column:
    """Split text into sentences.

    Rule: a sentence ends at ``.``, ``!`` or ``?`` followed by whitespace (one
    split on the whitespace after the mark, by look-behind). Leading/trailing
    whitespace is dropped and empty pieces are removed. The SQL twin (RE2, no
    look-behind) marks the break with char(1) and splits on that instead.
    """
    col = _c(c)
    # trimmed without a regex, but where its "$" would also match before a last line separator
    ends = F.right(col, F.lit(1)).isin("\u0085", "\u2028", "\u2029")
    stripped = F.when(ends, strip_ws(col)).otherwise(F.btrim(col, F.lit(" \t\r\n\f\x0b")))
    return F.array_remove(F.split(stripped, SENTENCE_SPLIT), "")
