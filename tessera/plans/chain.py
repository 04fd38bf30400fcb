"""Prompt chains: a step table run over a prompt table as one lazy plan.

A step table (``input, action, option, next_df`` in row order) is compiled on
the driver into a list of ``DataFrame -> DataFrame`` transforms; running it
folds them over the prompt DataFrame. Nothing iterates over rows: every
prompt goes through every step inside the same Spark plan, and the plan only
runs when the caller acts on the result.
"""

from __future__ import annotations

import ast
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from hashlib import md5
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.guided import named_regex
from tessera.functions.template import render
from tessera.functions.text import (
    DEFAULT_ASSISTANT_TAG,
    DEFAULT_USER_TAG,
    TOO_LONG_MSG,
    count_tokens,
    strip_list,
)
from tessera.operators import ask as A
from tessera.operators import complete as K
from tessera.operators import library as L
from tessera.operators import pages as P
from tessera.operators import results as E
from tessera.session import pinned, scratch_path
from tessera.sources.keyed import KeyedStore

NEXT = "next"
STATEMENT_BLOCK = 256      # statements that the driver holds at a time
# grammar file name -> shipped format name
GRAMMAR_FORMATS = {"urllist": "urllist", "singleexpression": "singleexpression", "python_script": "python_script",
                   "student_id": "student", "cars": "cars", "example1": "example1", "news": "news",
                   "example": "delivery"}


@dataclass
class Step:
    step_no: int
    input: str
    action: str
    option: dict
    next_df: str


@dataclass
class ChainContext:
    """What the actions need besides the prompt rows."""

    spark: SparkSession
    completer_factory: Callable | None = None
    max_length: int = K.DEFAULT_MAX_LENGTH
    context_size: int = K.DEFAULT_CONTEXT
    user_tag: str = DEFAULT_USER_TAG
    assistant_tag: str = DEFAULT_ASSISTANT_TAG
    key: str = "row_id"
    pages: DataFrame | None = None
    library: DataFrame | None = None          # chunk_id, text, source, content_hash, embedding
    encoder: dict = field(default_factory=dict)  # L.embed's arguments (dim, encoder_factory) that made the library
    selected_ids: DataFrame | None = None      # content_hash of the chosen documents
    result_store: "DataFrame | KeyedStore | None" = None   # id, user_id, session_id, stored_result_name, text
    page_index: "P.PageIndex | None" = None    # built once for many internet_search steps
    vector_index: "L.VectorIndex | None" = None  # built once over library + selected_ids
    active_view: str = "df"
    views: tuple[str, ...] | None = None       # what statements may read; the active table alone where not given
    pending_results: list = field(default_factory=list)
    last_result: DataFrame | None = None
    repair: Callable[[str, str], str] | None = None   # (statement, error) -> statement; default: ask the model
    statement_jobs: int = 8                    # statements that run at the same time


# G1 ------------------------------------------------------------------------
def parse_option(text: str | None) -> dict:
    """A step's option: a Python dict literal, blank -> no options (parsed once per step)."""
    text = (text or "").strip()
    if not text:
        return {}
    value = ast.literal_eval(text)
    if not isinstance(value, dict):
        raise ValueError(f"option is not a dict: {text!r}")
    return value


def compile_chain(steps) -> list[Step]:
    """G1: step table -> ordered steps (fields trimmed, options parsed).

    ``steps`` is a DataFrame with a ``step_no`` column (a step table is a few
    rows, so it is read to the driver as the plan) or a list of rows.
    """
    if isinstance(steps, DataFrame):
        rows = [r.asDict() for r in steps.orderBy("step_no").collect()]
    else:
        rows = [dict(r) if not isinstance(r, (tuple, list)) else
                dict(zip(("input", "action", "option", "next_df"), r)) for r in steps]
    out = []
    for i, r in enumerate(rows):
        out.append(Step(int(r.get("step_no", i)), (r.get("input") or "").strip(), (r.get("action") or "").strip(),
                        parse_option(r.get("option")), (r.get("next_df") or "").strip()))
    return out


#: quoted texts, what stands between them, and a quote that nothing closes
_LITERAL_PIECES = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]"""


def compile_steps(steps: DataFrame) -> DataFrame:
    """G1 over many step tables at once, natively: trimmed fields, the option as
    ``map<string,string>`` and whether the action is known (unknown ones are
    skipped when run). A simple dict literal (string keys, scalar values) is
    read as JSON: quotes are swapped, and words of Python changed outside quoted
    texts only; anything else gives a null map, and ``compile_chain`` (driver
    side, per table) stays the exact parser."""
    opt = F.trim(F.coalesce(F.col("option"), F.lit("")))
    pieces = F.regexp_extract_all(opt, F.lit(_LITERAL_PIECES), F.lit(0))

    def as_json(piece):
        inner = F.regexp_replace(F.substr(piece, F.lit(2), F.length(piece) - 2), r"\\'", "'")
        inner = F.regexp_replace(inner, r'(?<!\\)"', '\\\\"')
        plain = piece
        for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
            plain = F.regexp_replace(plain, rf"\b{python}\b", json)
        return F.when(piece.startswith("'"), F.concat(F.lit('"'), inner, F.lit('"'))).when(piece.startswith('"'), piece).otherwise(plain)

    as_json = F.array_join(F.transform(pieces, as_json), "")
    known = F.trim("action").isin(list(ACTIONS))
    return steps.select(
        *[c for c in steps.columns if c not in ("input", "action", "option", "next_df")],
        F.trim("input").alias("input"), F.trim("action").alias("action"),
        F.when(opt == "", F.create_map().cast("map<string,string>"))
        .otherwise(F.from_json(as_json, "map<string,string>")).alias("options"),
        known.alias("known"), F.trim("next_df").alias("next_df"))


# G6 ------------------------------------------------------------------------
ACTIONS: dict[str, Callable[..., DataFrame]] = {}
ROW_WISE: set[str] = set()     # actions that use the frame once, row by row
MODELS: set[str] = set()       # actions whose result must not be computed twice


def register_action(name: str, fn: Callable[..., DataFrame], row_wise: bool = False, model: bool = False) -> None:
    """``fn(df, input_col, ctx, **options) -> df`` with a string ``result`` column.

    An action that is not ``row_wise`` may use its frame several times: it is given a written table where models or such
    actions came before it, and it is refused on streams.
    """
    ACTIONS[name] = fn
    for group, member in ((ROW_WISE, row_wise), (MODELS, model)):
        (group.add if member else group.discard)(name)


def action(name, **kind):
    def deco(fn):
        register_action(name, fn, **kind)
        return fn
    return deco


@action("user_input", row_wise=True)
def _user_input(df, inp, ctx, **_):
    """Pass-through."""
    return df.withColumn("result", inp)


@action("ResetFullPrompt", row_wise=True)
def _reset_full_prompt(df, inp, ctx, **_):
    """Strip the list wrapping and make it the full prompt of later steps."""
    return df.withColumn("result", strip_list(inp, guarded=False)).withColumn("full_prompt", F.col("result"))


@action("llm_completion", row_wise=True, model=True)
def _llm_completion(df, inp, ctx, max_length=None, grammar=None, **options):
    """K1 in a chain: every option of the step reaches the model."""
    if ctx.completer_factory is None:
        raise ValueError("llm_completion needs ctx.completer_factory")
    fmt = None
    if grammar:
        fmt = named_regex(GRAMMAR_FORMATS[os.path.splitext(os.path.basename(grammar))[0]])
    ans = K.complete(inp, ctx.completer_factory, max_length or ctx.max_length, ctx.context_size, fmt,
                     budget=ctx.context_size - ctx.max_length,
                     options={**options, **({"grammar": grammar} if grammar else {})})
    return df.withColumn("result", ans)


@action("getwebpage")
def _getwebpage(df, inp, ctx, **_):
    return P.first_page(df.withColumn("_in", inp), "_in", ctx.pages, ctx.key).drop("_in")


@action("internet_search")
def _internet_search(df, inp, ctx, **_):
    qs = df.select(ctx.key, inp.alias("query"))
    if ctx.page_index is None:
        ctx.page_index = P.build_page_index(ctx.pages)
    notes = P.format_notes(P.search_page_index(qs, ctx.page_index, qkey=ctx.key), qkey=ctx.key)
    return (df.drop("result").join(notes, ctx.key, "left")
            .withColumn("result", F.coalesce("notes", F.lit(""))).drop("notes"))


@action("docu_search")
def _docu_search(df, inp, ctx, k: int = L.SEARCH_K, **_):
    # the prompts are embedded by what embedded the library
    qv = L.embed(df.select(ctx.key, inp.alias("_q")), ctx.key, "_q", **ctx.encoder).select(
        F.col(ctx.key).alias("qid"), F.col("embedding").alias("qvec"))
    lib = ctx.library.select(F.col("chunk_id").alias("cid"), "embedding", "content_hash", "text", "source")
    if ctx.vector_index is None:
        ctx.vector_index = L.build_index(lib.select("cid", "embedding", "content_hash"), ctx.selected_ids)
    hits = L.search_index(qv, ctx.vector_index, k=k)
    ctxt = L.assemble_context(hits.join(lib.select("cid", "text", "source"), "cid"))
    return (df.drop("result").join(ctxt.withColumnRenamed("qid", ctx.key), ctx.key, "left")
            .withColumn("result", F.coalesce("context", F.lit(""))).drop("context"))


@action("MemorizeResult")
def _memorize(df, inp, ctx, stored_result_name="result", **_):
    """E1 inside a chain: the input passes through; the rows to store are kept
    in ``ctx.pending_results`` (seen by later steps) and appended by
    ``commit_results``. A prompt over the budget stores nothing."""
    out = df.withColumn("result", inp)
    ctx.pending_results.append(out.filter(F.col("result").isNotNull()).select("user_id", "session_id", F.lit(
        stored_result_name).alias("stored_result_name"), F.col("result").alias("text"), F.col(ctx.key).alias("_order")))
    return out


def _memorized(ctx: ChainContext) -> DataFrame | None:
    """Every row that the chain memorized, in the order of its steps."""
    steps = [p.withColumn("_order", F.struct(F.lit(i).alias("step"), F.col("_order").alias("row")))
             for i, p in enumerate(ctx.pending_results)]
    return reduce(DataFrame.unionByName, steps) if steps else None


def pending_rows(ctx: ChainContext) -> DataFrame | None:
    """What the chain memorized so far, one row per key; an earlier step's row comes first, what is stored before all."""
    rows, store = _memorized(ctx), ctx.result_store
    if rows is None:
        return None
    return E.memorize_results(rows, store.read(rows) if isinstance(store, KeyedStore) else store, "_order")


@action("getMemoryResult")
def _recall(df, inp, ctx, stored_result_name="result", **_):
    """E2 inside a chain: the stored text of (user, session, name), also one
    memorized earlier in this chain, else ``None``. One row per key, so the
    left join keeps one row per prompt."""
    wanted = df.select("user_id", "session_id", F.lit(stored_result_name).alias("stored_result_name")).distinct()
    store = ctx.result_store
    if isinstance(store, KeyedStore):
        store = store.read(wanted)                            # the folders of the batch's keys
    held = [t.select(*E.RESULT_KEY, "text") for t in (store, pending_rows(ctx)) if t is not None]
    if not held:
        return df.withColumn("result", F.lit("None"))
    # of the store, only the batch's keys go on to the join; equal keys match, also null with null
    got = E.recall_results(wanted, E.wanted_rows(reduce(DataFrame.unionByName, held), wanted)).select(
        F.col("user_id").alias("_user"), F.col("session_id").alias("_session"), F.col("text").alias("_recalled"))
    out = df.join(got, df["user_id"].eqNullSafe(got["_user"]) & df["session_id"].eqNullSafe(got["_session"]), "left")
    return out.withColumn("result", F.coalesce("_recalled", F.lit("None"))).drop("_user", "_session", "_recalled")


@action("csv_peek", row_wise=True)
def _csv_peek(df, inp, ctx, **_):
    """I1 on the active table; the text is the same for every row (count + 5 rows)."""
    view = ctx.spark.table(ctx.active_view)
    head = A.peek(view, view.columns[0])
    n = head.select("n_records").first()
    rows = head.drop("n_records").collect()
    table = A.markdown_table(view.columns, rows)
    text = A.PEEK_TEXT.format(records=n[0] if n else 0, table=table)
    return df.withColumn("result", F.lit(text))


def _model_repair(ctx: ChainContext):
    """Asks the model for a better statement."""
    if ctx.completer_factory is None:
        return None

    def repair(statement: str, error: str) -> str:
        prompt = (f"{ctx.user_tag}This Spark SQL query failed.\n{statement}\nThe error was: {error}\nReply with JSON that "
                  f"holds a corrected query under the key df.{ctx.assistant_tag}")
        model = ctx.completer_factory()
        return model([prompt], **K.accepted_options(model, {"max_length": ctx.max_length}))[0]

    return repair


@action("execute_df_expression")
def _execute(df, inp, ctx, **_):
    """I2 for every distinct statement of the prompts, some at a time as Spark
    jobs of their own; each result is saved once (A4) and its report joined
    back. Statements pass the driver in blocks, reports are written as a table."""
    spark, root = ctx.spark, scratch_path(ctx.spark, "statements")
    repair = ctx.repair or _model_repair(ctx)
    statements = (r[0] for r in df.select(inp.alias("s")).distinct().toLocalIterator() if r[0] is not None)

    def run(s):
        return (s, *A.answer(spark, s, f"{root}/{md5(s.encode()).hexdigest()}", repair, views=ctx.views or (ctx.active_view,)))

    reports, block = f"{root}/reports", 0
    with ThreadPoolExecutor(ctx.statement_jobs) as pool:
        while part := list(islice(statements, STATEMENT_BLOCK)):
            done = list(pool.map(run, part))
            spark.createDataFrame(done, "_s string, _t string, _p string").write.parquet(f"{reports}/block={block}")
            saved = [p for _, _, p in done if p]
            if saved:
                ctx.last_result = spark.read.parquet(saved[-1])
            block += 1
    if not block:
        return df.withColumn("result", F.lit(A.FAILED_MSG))
    table = spark.read.parquet(reports).select("_s", "_t")
    out = df.withColumn("_s", inp).join(table, "_s", "left")  # AQE picks the join side
    return out.withColumn("result", F.coalesce("_t", F.lit(A.FAILED_MSG))).drop("_s", "_t")


@action("distinct_counts", row_wise=True)
def _distinct_counts(df, inp, ctx, **_):
    """I4 on the active table; the text is the same for every row (one number per column)."""
    counts = A.nunique(ctx.spark.table(ctx.active_view)).collect()
    return df.withColumn("result", F.lit(A.markdown_table(["column", "distinct values"], [tuple(r) for r in counts])))


@action("ReuseDf", row_wise=True)
def _reuse(df, inp, ctx, **_):
    """A5: the last result becomes the active table."""
    if ctx.last_result is not None:
        ctx.last_result.createOrReplaceTempView(ctx.active_view)
    return df.withColumn("result", F.lit(""))


# G2 / G5 -------------------------------------------------------------------
def run_chain(prompts: DataFrame, steps, ctx: ChainContext, prompt_col: str = "prompt",
              log: bool = False, include_history: bool = False, order: str = "ts",
              history_chars: int | None = None, memory: DataFrame | None = None,
              reload: int | None = None) -> DataFrame:
    """Run every step over every prompt row.

    With ``memory`` (a table of stored turns) each prompt is preceded by its
    session's latest ``reload`` turns (F5), as many as fit the model's context
    beside the prompt (F3), in time order (F2); ``store_turns`` adds the new
    turns after the run.

    ``full_prompt = user_tag + prompt + assistant_tag``; a prompt over the token
    budget gets the fixed error text and its rows skip the model. Each step
    renders its template from ``full_prompt`` and the previous ``result``
    (``None`` before the first), applies its action and replaces ``result``.
    Unknown actions are skipped. With ``log`` an array of
    ``(step_no, action, input, result)`` is kept per row (G5). With
    ``include_history`` each prompt is preceded by the earlier prompts of its
    session (by ``order``), as F4 builds it; ``history_chars`` keeps only the
    latest ones that fit.
    """
    compiled = compile_chain(steps) if not isinstance(steps, list) or not steps or not isinstance(
        steps[0], Step) else steps
    if memory is not None:
        from tessera.operators import memory as M

        turns = M.load_sessions(memory, prompts.select(*M.SESSION).distinct(), reload or M.RELOAD_LIMIT, latest=True)
        # each prompt takes, of its session's at most ``reload`` turns, the latest that fit beside itself
        budget = ctx.context_size - ctx.max_length
        loaded = M.session_turns(M.sliding_memory(turns, budget))
        tagged = F.concat(F.lit(ctx.user_tag), F.col(prompt_col), F.lit(ctx.assistant_tag))
        df = prompts.join(loaded, M.SESSION, "left").withColumn("full_prompt", F.concat(
            F.coalesce(M.fitting_history("_turns", F.length(tagged), budget), F.lit("")), tagged)).drop("_turns")
    elif include_history:
        # earlier prompts of the session come first; a batch stores no answers,
        # so earlier turns carry empty answers (F4 over the prompt rows), all of
        # them or the latest that fit in ``history_chars``
        from tessera.operators.memory import with_history_prompt

        df = with_history_prompt(prompts, prompt_col, F.lit(""), ctx.user_tag, ctx.assistant_tag, order,
                                 history_chars)
    else:
        df = prompts.withColumn("full_prompt", F.concat(F.lit(ctx.user_tag), F.col(prompt_col),
                                                        F.lit(ctx.assistant_tag)))
    gated = count_tokens("full_prompt") > F.lit(float(ctx.context_size - ctx.max_length))
    df = df.withColumn("_gated", gated).withColumn("result", F.lit(None).cast("string"))
    if log:
        df = df.withColumn("log", F.array().cast(
            "array<struct<step_no:int,action:string,input:string,result:string>>"))
    used = False                       # models or several uses of the frame lie before the step
    for st in compiled:
        fn = ACTIONS.get(st.action)
        if fn is None:
            continue
        if st.action not in ROW_WISE:
            if df.isStreaming:
                raise ValueError(f"{st.action} uses its rows more than once and cannot run on a stream")
            df = pinned(df, "chain") if used else df
        used = used or st.action in MODELS or st.action not in ROW_WISE
        rendered = render(st.input, full_prompt=F.col("full_prompt"), result=F.col("result"))
        df = df.withColumn("_input", F.when(~F.col("_gated"), rendered))
        df = fn(df, F.col("_input"), ctx, **st.option)
        if log:
            df = df.withColumn("log", F.array_append("log", F.struct(
                F.lit(st.step_no).alias("step_no"), F.lit(st.action).alias("action"),
                F.col("_input").alias("input"), F.col("result").alias("result"))))
    df = df.withColumn("result", F.when(F.col("_gated"), F.lit(TOO_LONG_MSG)).otherwise(F.col("result")))
    return df.drop("_input", "_gated")


def step_log(chain_out: DataFrame, key: str = "row_id") -> DataFrame:
    """One row per (prompt, step)."""
    return chain_out.select(key, F.inline("log"))


def batch_report(chain_out: DataFrame, key: str = "row_id", prompt_col: str = "prompt") -> DataFrame:
    """One (prompt, result) pair per input row, in input order."""
    return chain_out.select(key, prompt_col, "result").orderBy(key)


def commit_results(ctx: ChainContext, store_path: str) -> None:
    """Append the results memorized during a chain (insert if absent)."""
    if not ctx.pending_results:
        return
    ctx.result_store = E.result_store(ctx.spark, store_path)
    E.memorize_into(pinned(_memorized(ctx), "results"), store_path, "_order")
    ctx.pending_results.clear()


def store_turns(chain_out: DataFrame, memory_path: str, ctx: ChainContext, prompt_col: str = "prompt") -> None:
    """F1 after a run: prompt and answer of every row that was within the budget become a turn of its session."""
    from tessera.operators import memory as M

    done = chain_out.filter(F.col("result") != TOO_LONG_MSG).select(
        *M.SESSION, "ts", F.col(prompt_col).alias("user_prompt"), F.col("result").alias("llm_answer"))
    M.append_turns(done, memory_path, ctx.user_tag, ctx.assistant_tag)


# G3 ------------------------------------------------------------------------
def last_next(steps: list[Step]) -> str:
    """The table a run leads to: ``next_df`` of the last step that executes."""
    target = NEXT
    for st in steps:
        if st.action in ACTIONS:
            target = st.next_df or NEXT
    return target


def route(catalog: dict[str, list[Step]], start: str) -> tuple[list[str], int]:
    """Tables used by a session's prompts: ``(walk, cycle_start)``.

    ``next`` stays in the current table, any other value names the next one.
    Prompt ``i`` uses ``walk[i]`` while ``i < len(walk)``; later prompts repeat
    ``walk[cycle_start:]``. The walk ends at the first repeated table.
    """
    walk, seen, cur = [], {}, start
    while cur not in seen:
        seen[cur] = len(walk)
        walk.append(cur)
        nxt = last_next(catalog[cur])
        cur = cur if nxt in (NEXT, "") else nxt
    return walk, seen[cur]


def catalog_from_sequences(sequences: DataFrame, name_col: str = "file") -> dict[str, list[Step]]:
    """Step tables read by A2 (``read_sequences``) as a routing catalog keyed by
    file name; ``next_df`` values name other files of the catalog. The
    catalog is a handful of small tables, read to the driver as the plan."""
    import posixpath

    rows = sequences.orderBy(name_col, "step_no").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(posixpath.basename(r[name_col]), []).append(
            {"step_no": r["step_no"], "input": r["input"], "action": r["action"], "option": r["option"],
             "next_df": posixpath.basename(r["next_df"] or "") if r["next_df"] not in (None, "", NEXT) else NEXT})
    return {name: compile_chain(steps) for name, steps in out.items()}


def run_program(prompts: DataFrame, catalog: dict, start: str, ctx: ChainContext, order: str = "ts",
                session=("user_id", "session_id"), prompt_col: str = "prompt") -> DataFrame:
    """Each session's prompts in order; prompt ``i`` runs the table reached
    after ``i`` routings from ``start``. The route depends only on the step
    tables, so it is computed on the driver and each table's chain runs once
    over all prompts routed to it."""
    from tessera.operators.memory import positions

    compiled = {name: s if s and isinstance(s[0], Step) else compile_chain(s) for name, s in catalog.items()}
    walk, mu = route(compiled, start)
    lam = len(walk) - mu
    pos = F.col("_pos")
    idx = F.when(pos < len(walk), pos).otherwise(F.lit(mu) + F.pmod(pos - mu, F.lit(lam)))
    # written once: every table of the route reads its part
    routed = pinned(positions(prompts, order, list(session)).withColumn(
        "table", F.element_at(F.array(*[F.lit(t) for t in walk]), (idx + 1).cast("int"))).drop("_pos"), "routed")
    out = None
    for name in walk:
        part = run_chain(routed.filter(F.col("table") == name), compiled[name], ctx, prompt_col)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

