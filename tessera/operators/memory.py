"""Conversation memory over flat turn rows.

A turn row is ``user_id, session_id, ts, user_prompt, llm_answer``. The nested
per-user/per-session dictionaries of an interactive chat become plain columns,
so every operator is a join, an aggregation or a window keyed by
``(user_id, session_id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import (
    DEFAULT_ASSISTANT_TAG,
    DEFAULT_USER_TAG,
    TOKEN_CHARS,
    is_valid_json,
)
from tessera.operators.scans import in_parts, joined, running
from tessera.sources.keyed import KeyedStore

SESSION = ["user_id", "session_id"]
# Fixed values that must equal the reference's for right results.
SUMMARY_PLACEHOLDER = "Placeholder summary of the session."
SESSION_SUFFIX = "_Session"
RELOAD_LIMIT = 10


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Adapter: the driver's ``conversations`` as raw turn rows.

    ``user_id = 'u' + conv_id % 10``, ``session_id = 's' + conv_id`` and the
    turn time is 2024-01-01 plus ``turn`` minutes.
    """
    return conversations.select(
        F.concat(F.lit("u"), F.pmod("conv_id", F.lit(10)).cast("string")).alias("user_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("turn"))).alias("ts"),
        "conv_id", "turn", "role", "text",
    )


# F7 ------------------------------------------------------------------------
PART_ROWS = 1024              # numbers of a part of a session
PART_MICROS = 3_600_000_000   # or, by time, an hour


def session_part(df: DataFrame, order: str):
    """(place as a number, part) of a row in its session: parts of one session are handled by many tasks."""
    timed = dict(df.dtypes)[order] in ("timestamp", "timestamp_ntz")
    place = F.unix_micros(F.col(order).cast("timestamp")) if timed else F.col(order).cast("bigint")
    return place, F.floor(place / F.lit(PART_MICROS if timed else PART_ROWS))


def positions(df: DataFrame, order: str, keys=SESSION, into: str = "_pos") -> DataFrame:
    """``into``: the number of earlier rows of the session by ``order``; counts of the parts before are added to places inside a part."""
    _, part = session_part(df, order)
    parted = df.withColumn("_part", part)
    counts = parted.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1
    return joined(parted.withColumn(into, inside), starts, keys).withColumn(into, (F.col(into) + F.col("_start")).cast("bigint")) \
        .drop("_part", "_start")


def chat_pairs(rows: DataFrame, seq: str | None = "turn") -> DataFrame:
    """``(prompt, answer)`` per user row; the answer is the next row's text
    when that row is the assistant's, else empty text.

    The next row is the next one of the session by ``seq`` (by time without
    it), whatever lies between their numbers. A session is looked at in parts
    of ``PART_ROWS`` numbers; the last row of a part is followed by the first of
    the next part that has rows, so a hot session is spread over many tasks.
    """
    place, part = session_part(rows, seq if seq is not None and seq in rows.columns else "ts")
    said = rows.select(*SESSION, "ts", F.col("role").alias("_role"), F.col("text").alias("_text"), place.alias("_at"), part.alias("_part"))
    first = said.groupBy(*SESSION, "_part").agg(F.min_by(F.struct("_role", "_text"), F.struct("_at", "_role")).alias("_first"))
    after = first.select(*SESSION, "_part", F.lead("_first").over(Window.partitionBy(*SESSION).orderBy("_part")).alias("_after"))
    inside = F.lead(F.struct("_role", "_text")).over(Window.partitionBy(*SESSION, "_part").orderBy("_at", "_role"))
    pairs = joined(said.withColumn("_next", inside).filter(F.col("_role") == "user"), after, SESSION)
    following = F.coalesce("_next", "_after")
    return pairs.select(*SESSION, "ts", F.col("_text").alias("user_prompt"),
                        F.when(following["_role"] == "assistant", following["_text"]).otherwise(F.lit("")).alias("llm_answer"))


# F1 ------------------------------------------------------------------------
def tag_turns(turns: DataFrame, user_tag: str = DEFAULT_USER_TAG,
              assistant_tag: str = DEFAULT_ASSISTANT_TAG) -> DataFrame:
    """Prompt and answer as stored: with their role tags, plus the JSON document; a null text is empty."""
    t = turns.select(*SESSION, "ts",
                     F.concat(F.lit(user_tag), F.coalesce("user_prompt", F.lit(""))).alias("user_prompt"),
                     F.concat(F.lit(assistant_tag), F.coalesce("llm_answer", F.lit(""))).alias("llm_answer"))
    return t.withColumn("document", F.to_json(F.struct("user_prompt", "llm_answer",
                                                        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                                                        .alias("timestamp"))))


MEMORY_SCHEMA = "user_id string, session_id string, ts timestamp, user_prompt string, llm_answer string, document string"


def memory_store(spark: SparkSession, memory_path: str) -> KeyedStore:
    """The memory table: turns by (user, session, ts), the turns of a session in one folder."""
    return KeyedStore(spark, memory_path, MEMORY_SCHEMA, (*SESSION, "ts"), tuple(SESSION))


def append_turns(turns: DataFrame, memory_path: str, user_tag: str = DEFAULT_USER_TAG,
                 assistant_tag: str = DEFAULT_ASSISTANT_TAG) -> None:
    """append tagged turns to the memory table, idempotent by (user, session, ts).

    Rows already stored under the same key are skipped, so a retried batch does
    not double them (null with null); of equal keys in one batch the least turn is
    kept. Only the folders of the batch's sessions are read.
    """
    memory_store(turns.sparkSession, memory_path).add(tag_turns(turns, user_tag, assistant_tag))


def read_memory(spark, memory_path: str, sessions: DataFrame | None = None) -> DataFrame:
    """All turns, or those of ``sessions``, of which only the folders are read."""
    store = memory_store(spark, memory_path)
    return store.read() if sessions is None else store.matching(sessions)


# F2 ------------------------------------------------------------------------
def session_history(turns: DataFrame) -> DataFrame:
    """per session, ``prompt + ' ' + answer + ' '`` for all turns by time; a null text is empty."""
    _, piece = _piece("user_prompt", "llm_answer")
    return turns.groupBy(*SESSION).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("o"), piece.alias("t")))),
                                 lambda s: s["t"]), "").alias("history"))


# F3 ------------------------------------------------------------------------
def turn_cost():
    """Characters of a turn in the history; a null text has none."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return size("user_prompt") + size("llm_answer") + 2


def sliding_memory(turns: DataFrame, max_tok: float, prompts: DataFrame | None = None,
                   user_tag: str = DEFAULT_USER_TAG, assistant_tag: str = DEFAULT_ASSISTANT_TAG) -> DataFrame:
    """the longest suffix of each session's turns whose history fits ``max_tok``.

    Dropping the earliest turns until the rest fits keeps exactly the turns whose
    newest-first running length stays within the budget. With ``prompts``
    (``user_id, session_id, prompt``) the tagged prompt counts against it too.
    Returns the kept turns with ``suffix_chars`` (history length from that turn on);
    with ``prompts`` once for each prompt of the session, with the prompt's other columns.
    """
    cost = turn_cost()
    # Every turn costs at least 2 characters, so at most budget/2 + 1 of the
    # newest turns can fit. The row-number limit runs as a partial
    # WindowGroupLimit before the shuffle, so even a session holding a third
    # of all rows sends a bounded number of rows per task; the result is the
    # same as without it.
    newest = int(max_tok * TOKEN_CHARS // 2) + 1
    order = Window.partitionBy(*SESSION).orderBy(F.col("ts").desc())
    t = turns.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= newest)
    t = t.withColumn("suffix_chars", F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0))
                     .cast("bigint")).drop("_rn")
    extra = F.lit(0)
    if prompts is not None:
        other = [c for c in prompts.columns if c not in (*SESSION, "prompt", *t.columns)]
        t = t.join(prompts.select(*SESSION, *other, F.length(F.concat(F.lit(user_tag), F.coalesce("prompt", F.lit("")), F.lit(assistant_tag)))
                                  .alias("_pl")), SESSION, "left")
        extra = F.coalesce(F.col("_pl"), F.lit(0))
    return t.filter((F.col("suffix_chars") + extra) / F.lit(TOKEN_CHARS) <= F.lit(float(max_tok))).drop("_pl")


def session_turns(kept: DataFrame) -> DataFrame:
    """``_turns`` per session: the turns that ``sliding_memory`` kept, by time, with their ``suffix_chars``."""
    _, piece = _piece("user_prompt", "llm_answer")
    return kept.groupBy(*SESSION).agg(F.array_sort(F.collect_list(
        F.struct(F.col("ts").alias("o"), piece.alias("t"), F.col("suffix_chars").alias("n")))).alias("_turns"))


def fitting_history(turns: str, prompt_chars, max_tok: float):
    """F2 of the longest suffix of ``session_turns`` that fits ``max_tok`` beside a prompt of ``prompt_chars`` (F3), as a Column."""
    extra = F.coalesce(prompt_chars, F.lit(0))
    fits = F.filter(turns, lambda s: (s["n"] + extra) / F.lit(TOKEN_CHARS) <= F.lit(float(max_tok)))
    return F.array_join(F.transform(fits, lambda s: s["t"]), "")


# F4 ------------------------------------------------------------------------
WINDOW_CHARS = 1 << 18        # characters of a session in a window, where the budget is not more


def _piece(prompt, answer):
    text = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return text(prompt), F.concat(text(prompt), F.lit(" "), text(answer), F.lit(" "))


def _history_text(before, p, user_tag: str, assistant_tag: str):
    return F.concat(F.regexp_replace(before, r"^[ \t\r\n\f\x0b]+", ""), F.lit(" "), F.lit(user_tag), p,
                    F.lit(assistant_tag))


def history_prompt(prompt="user_prompt", answer="llm_answer", user_tag: str = DEFAULT_USER_TAG,
                   assistant_tag: str = DEFAULT_ASSISTANT_TAG, order: str = "ts"):
    """F4 as a Column: ``lstrip(earlier turns) + ' ' + user_tag + prompt + assistant_tag``.

    Earlier turns are ``prompt + ' ' + answer + ' '`` of the same session by
    ``order`` (a window up to the row before); the first turn gets one leading
    space, later turns two spaces before the tag.
    """
    p, piece = _piece(prompt, answer)
    w = Window.partitionBy(*SESSION).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return _history_text(F.array_join(F.collect_list(piece).over(w), ""), p, user_tag, assistant_tag)


def with_history_prompt(df: DataFrame, prompt="user_prompt", answer="llm_answer",
                        user_tag: str = DEFAULT_USER_TAG, assistant_tag: str = DEFAULT_ASSISTANT_TAG,
                        order: str = "ts", max_chars: int | None = None, into: str = "full_prompt") -> DataFrame:
    """F4 as a column ``into`` of ``df``.

    A session is worked on in parts (see ``scans``): the text of all parts before
    a part is joined once and put in front of the part's own. With ``max_chars``
    only the latest earlier turns whose pieces fit in ``max_chars`` together are
    kept (the longest fitting suffix, as in F3). Each turn's start (characters of
    its session before it) is strictly increasing, since a piece has at least
    two characters, so a RANGE frame ``max_chars`` preceding to 1 preceding over
    it is exactly that suffix; windows are cut by start, and the turns within
    ``max_chars`` of a cut stand in the next one too.
    """
    p, piece = _piece(prompt, answer)
    parts = in_parts(df, SESSION, [order])
    if max_chars is None:
        out = running(parts, {"_before": ("text", piece)}, current=False)
        return out.withColumn(into, _history_text(F.col("_before"), p, user_tag, assistant_tag)).drop("_before")
    cost = F.length(piece).cast("long")
    out = running(parts, {"_end": ("sum", cost)}).withColumn("_start", F.col("_end") - cost).drop("_end")
    wide = F.lit(max(int(max_chars), WINDOW_CHARS))
    cut = F.floor(F.col("_start") / wide)
    nearly = F.pmod("_start", wide) >= wide - F.lit(int(max_chars))
    dealt = out.withColumn("_cut", F.explode(F.when(nearly, F.array(cut, cut + 1)).otherwise(F.array(cut))))
    fit = Window.partitionBy(*SESSION, "_cut").orderBy("_start").rangeBetween(-int(max_chars), -1)
    before = F.array_join(F.collect_list(piece).over(fit), "")
    return dealt.withColumn(into, _history_text(before, p, user_tag, assistant_tag)).where(F.col("_cut") == cut).drop("_start", "_cut")


def prompt_with_history(turns: DataFrame, user_tag: str = DEFAULT_USER_TAG,
                        assistant_tag: str = DEFAULT_ASSISTANT_TAG, max_chars: int | None = None) -> DataFrame:
    """each turn's prompt preceded by the earlier turns of its session
    (all of them, or with ``max_chars`` the latest ones that fit)."""
    out = with_history_prompt(turns, "user_prompt", "llm_answer", user_tag, assistant_tag, "ts", max_chars)
    return out.select(*SESSION, "ts", "full_prompt")


# F5 ------------------------------------------------------------------------
def load_sessions(memory: DataFrame, keys: DataFrame, n: int = RELOAD_LIMIT, latest: bool = False) -> DataFrame:
    """the first (or latest) ``n`` turns of each requested session, by time.

    The row-number filter becomes a WindowGroupLimit, applied before the
    shuffle as well, so at most ``n`` rows per session leave each task.
    """
    sel = memory.join(keys.select(*SESSION).distinct(), SESSION, "left_semi")
    order = F.col("ts").desc() if latest else F.col("ts")
    w = Window.partitionBy(*SESSION).orderBy(order)
    return sel.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# F6 ------------------------------------------------------------------------
def sessions_of(memory: DataFrame, users: DataFrame) -> DataFrame:
    """distinct sessions of the requested users."""
    return memory.join(users.select("user_id").distinct(), "user_id", "left_semi").select(*SESSION).distinct()


# F8 ------------------------------------------------------------------------
def drop_last_turn(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """F8: remove the newest turn of each requested session; others unchanged.

    ``max(ts)`` aggregates partially per task, so a hot session costs one row
    per task before the shuffle; the removal is an anti-join on that key.
    """
    last = (turns.join(sessions.select(*SESSION).distinct(), SESSION, "left_semi")
            .groupBy(*SESSION).agg(F.max("ts").alias("ts")))
    return turns.join(last, SESSION + ["ts"], "left_anti")


# F9 ------------------------------------------------------------------------
def archive_sessions(turns: DataFrame, summarizer=None) -> DataFrame:
    """one JSON document per session with all turns and a summary.

    ``summarizer`` maps the session's turns DataFrame to ``user_id,
    session_id, summary``; by default the fixed placeholder is used.
    """
    docs = turns.groupBy(*SESSION).agg(
        F.array_sort(F.collect_list(F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            "user_prompt", "llm_answer"))).alias("turns"))
    if summarizer is None:
        docs = docs.withColumn("summary", F.lit(SUMMARY_PLACEHOLDER))
    else:
        docs = docs.join(summarizer(turns), SESSION, "left")
    return docs.select(*SESSION, "summary", F.to_json(F.struct("turns", "summary")).alias("document"))


def model_summarizer(completer_factory, template: str = "Summarize this conversation: {history}",
                     max_length: int = 128, context_size: int = 4096):
    """A summarizer for ``archive_sessions``: the session history (F2) rendered
    into ``template`` and completed by the user's model (K1; over-budget
    histories get K1's fixed error text instead of reaching the model)."""
    from tessera.functions.template import render
    from tessera.operators.complete import complete

    def summarize(turns: DataFrame) -> DataFrame:
        h = session_history(turns)
        prompt = render(template, history=F.col("history"))
        return h.select(*SESSION, complete(prompt, completer_factory, max_length, context_size).alias("summary"))

    return summarize


# F10 -----------------------------------------------------------------------
TURN_SCHEMA = "user_prompt string, llm_answer string, timestamp string"


def parse_turns(df: DataFrame, col: str = "document") -> DataFrame:
    """parse stored turn documents; invalid JSON is skipped, a missing field is empty text."""
    ok = df.filter(is_valid_json(col)).withColumn("_t", F.from_json(F.col(col), TURN_SCHEMA))
    return ok.select(*[c for c in df.columns if c != col],
                     *[F.coalesce(F.col(f"_t.{f}"), F.lit("")).alias(f)
                       for f in ("user_prompt", "llm_answer", "timestamp")])


# F11 -----------------------------------------------------------------------
def new_session_id(ts) -> "F.Column":
    """compact timestamp (to microseconds) + ``_Session``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.date_format(ts, "yyyyMMddHHmmssSSSSSS"), F.lit(SESSION_SUFFIX))
