"""Batch completion with a user-supplied model function.

The model runs inside an iterator ``pandas_udf``: Arrow batches in, texts out,
and the model is built once per Python worker (``completer_factory`` is called
on the executor, not per row). The budget gate before and the stop/length cut
after are native columns, so rows over the budget never reach the model.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.guided import conforms
from tessera.functions.text import TOO_LONG_MSG, count_tokens, cut_completion

log = logging.getLogger(__name__)       # in the workers: their standard error

# Fixed values that must equal the reference's for right results.
DEFAULT_MAX_LENGTH = 128
DEFAULT_CONTEXT = 4096
COMPLETION_ERROR = "Error: Requested tokens exceed context window."
FORMAT_ERROR = "Error: Output does not follow the requested format."


def edge_words_stub(n: int = 5, last: bool = False) -> Callable[..., list[str]]:
    """A deterministic stand-in model: the first (or last) ``n`` space-separated words."""
    def complete(prompts: list[str], **options) -> list[str]:
        return [" ".join(p.split(" ")[-n:] if last else p.split(" ")[:n]) for p in prompts]
    return complete


_MODELS: dict[str, object] = {}


def cached_model(factory: Callable[[], object]):
    """The model built by ``factory``, once per Python worker process.

    The factory arrives freshly unpickled with every task, so it is keyed by its
    pickled form; reused workers (the default) keep the model between tasks.
    """
    import hashlib

    from pyspark import cloudpickle

    key = hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def accepted_options(model, options: dict) -> dict:
    """The options that a model's call takes: all of them with ``**``, else those it names."""
    import inspect

    try:
        parameters = inspect.signature(model).parameters.values()
    except (TypeError, ValueError):
        return {}
    if any(p.kind is p.VAR_KEYWORD for p in parameters):
        return options
    named = {p.name for p in parameters if p.kind in (p.KEYWORD_ONLY, p.POSITIONAL_OR_KEYWORD)}
    return {k: v for k, v in options.items() if k in named}


def _udf(completer_factory: Callable[[], Callable[..., list[str]]], options: dict):
    from tessera.session import ship_package

    ship_package()  # the active session's workers import this module
    @F.pandas_udf("string")
    def _complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = cached_model(completer_factory)
        given = accepted_options(model, options)
        for prompts in batches:
            todo = prompts.notna()  # null prompts (over budget) never reach the model
            texts = prompts[todo].tolist()
            try:
                done = list(model(texts, **given)) if texts else []
            except Exception:  # noqa: BLE001 - fall back to one prompt at a time
                log.warning("model failed on %d prompts; each is tried alone", len(texts), exc_info=True)
                done = []
                for t in texts:
                    try:
                        done.append(model([t], **given)[0])
                    except Exception:  # noqa: BLE001
                        log.warning("model failed on a prompt of %d characters", len(t), exc_info=True)
                        done.append(COMPLETION_ERROR)
            out = pd.Series([None] * len(prompts), index=prompts.index, dtype="object")
            out[todo] = done
            yield out

    return _complete.asNondeterministic()


def complete(prompt, completer_factory, max_length: int = DEFAULT_MAX_LENGTH,
             context_size: int = DEFAULT_CONTEXT, fmt_regex: str | None = None, stop: str = "[User]:",
             budget: float | None = None, options: dict | None = None) -> Column:
    """K1: the completion of each prompt, as a Column.

    The model is called as ``model(prompts, **options)`` with ``max_length``
    (in its own tokens) and whatever else ``options`` holds, as far as it takes them.
    Over-budget prompts (``len/3.5 > context_size - max_length``, or
    ``budget`` tokens when given) get the fixed error text and are not sent to
    the model. The answer is cut at ``stop``; its length is the model's matter. With ``fmt_regex`` an answer that does not conform
    is replaced by a fixed error text.
    """
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    limit = float(context_size - max_length) if budget is None else float(budget)
    over = count_tokens(p) > F.lit(limit)
    raw = _udf(completer_factory, {"max_length": max_length, **(options or {})})(F.when(~over, p))
    answer = cut_completion(raw, stop)
    if fmt_regex is not None:
        answer = F.when(conforms(answer, regex=fmt_regex), answer).otherwise(F.lit(FORMAT_ERROR))
    return F.when(over, F.lit(TOO_LONG_MSG)).otherwise(answer)
