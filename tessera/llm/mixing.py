"""Temperature mixing of sources, with DataFrame functions only.

A source's token share p becomes the weight p**a / sum(p**a). The exponent is the least a in [0, 1] whose weights keep both
limits: their entropy is at most ``target_entropy`` of the largest possible (ln of the number of sources), and no source
is repeated more than ``max_repeats`` times. Both fall as a rises, so the bracket is cut until it is narrow; every round
is one aggregate over the sources that tries ``CUTS`` - 1 inner points at once. If a = 1 keeps no limit, a is 1.

``budget`` tokens are dealt out by weight; without one, the budget is the least at which no source loses a document. A
source's documents follow in a hashed order, anew in every epoch, until its quota of tokens is used; equal parts of all
quotas make a block, and a block is a permutation by another hash. Tokens: words ``[^\\x20\\x09-\\x0D]+`` and one end.

Running sums are taken in parts of a source's order (``scans``), so a source of any size is spread over many tasks. The
order is by the hash of id and text, then by the number a row got when the rows were first written: also rows with
equal ids, or none, have places of their own, and ``mix`` returns the very rows of the plan. An explicit budget may
repeat a source more often than ``max_repeats`` allows the weights alone.

A null source counts as an empty one, a null text as empty; a null id is hashed as an empty one. An empty table gives an
empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, pin, table
from tessera.operators.scans import in_parts, running

TARGET_ENTROPY = 0.998
MAX_REPEATS = 1.5
BLOCK_TOKENS = 1 << 18
SEED = 17
CUTS = 32
ROUNDS = 6


def n_tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint") + 1


def _hashed(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def find_exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for a table of (source, tokens)."""
    total, largest, least, count = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).head()
    if not count:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * k / CUTS for k in range(CUTS)]
        powers = sources.select(share.alias("p"), F.explode(F.array(*map(F.lit, tried))).alias("a")).groupBy("a").agg(
            F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.ln("p")).alias("l")).collect()   # CUTS rows
        fits = [r["a"] for r in powers
                if math.log(r["z"]) - r["a"] * r["l"] / r["z"] <= target_entropy * math.log(count) + 1e-12
                and (largest / least) ** (1 - r["a"]) <= max_repeats]
        best = min(fits, default=high)
        low, high = (max([a for a in tried if a < best], default=low), best)
    return high


def source_weights(sources: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """source, tokens, share, weight, quota (tokens) and repeats for a table of (source, tokens)."""
    total, = sources.agg(F.sum("tokens")).head()
    p = F.col("tokens") / F.lit(float(total or 1))
    weighted = sources.withColumn("share", p).withColumn("raw", F.pow(p, F.lit(exponent)))
    z, need = weighted.agg(F.sum("raw"), F.max(F.col("tokens") / F.col("raw"))).head()
    size = F.lit(float(budget)) if budget is not None else F.lit((need or 0.0) * (z or 1.0))
    quota = F.col("raw") / F.lit(z or 1.0) * size
    return weighted.select("source", "tokens", "share", (F.col("raw") / F.lit(z or 1.0)).alias("weight"),
                           # a quota within a token of whole epochs is whole
                           F.greatest(F.floor(quota + 0.5), F.lit(0)).cast("bigint").alias("quota"),
                           (quota / F.col("tokens")).alias("repeats"))


def _narrow(docs: DataFrame, id_column: str, source: str, text: str, row) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                       n_tokens(text).alias("n_tokens"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("digest"), row.alias("row"))


def _key(seed: int, epoch, id_, digest) -> Column:
    return _hashed(F.lit(seed), epoch, id_, digest)


def mixing_plan(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text",
                target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None,
                block_tokens: int = BLOCK_TOKENS, seed: int = SEED, row_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per chosen copy: id, source, n_tokens, epoch, key, row, block, position; the table of weights).

    ``row_column`` numbers the rows of a written table; without it they are numbered here.
    """
    row = F.col(row_column) if row_column else F.monotonically_increasing_id()
    rows = pin(_narrow(docs, id_column, source, text, row), "mixing")
    counted = pin(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    exponent = find_exponent(counted, target_entropy, max_repeats)
    weights = pin(source_weights(counted, exponent, budget).withColumn("exponent", F.lit(exponent)), "weights")
    dealt = weights.agg(F.sum("quota")).head()[0] or 0
    blocks = max(1, -(-dealt // block_tokens))
    epochs = F.expr("sequence(0L, greatest(cast(ceil(quota / tokens) as bigint), 1L) - 1L)")
    copies = rows.join(weights.select("source", "tokens", "quota"), "source").withColumn("epoch", F.explode(epochs)) \
        .withColumn("key", _key(seed, F.col("epoch"), F.col("id"), F.col("digest"))).drop("digest")
    parts = in_parts(copies, ["source", "epoch"], ["key", "n_tokens", "row"])
    placed = running(parts, {"before": ("sum", "n_tokens")}, current=False) \
        .withColumn("start", F.col("epoch") * F.col("tokens") + F.coalesce("before", F.lit(0))) \
        .where("start < quota") \
        .withColumn("block", F.least(F.floor(F.col("start") * (F.lit(float(blocks)) / F.col("quota"))), F.lit(blocks - 1)).cast("bigint"))
    order = Window.partitionBy("block").orderBy(_hashed(F.lit(seed), F.lit("block"), F.col("epoch"), F.col("id")), "n_tokens", "key", "row")
    return placed.withColumn("position", F.row_number().over(order).cast("bigint")).select(
        "id", "source", "n_tokens", "epoch", "key", "row", "block", "position"), weights


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, **limits) -> DataFrame:
    """``docs`` with every row as often as the plan says (not in block order).

    The rows are written once with their numbers. Texts are not sent by the plan: in an epoch that is cut, a source keeps
    the rows up to its last one.
    """
    row, source_key, epoch, cut = (free_name(docs, x) for x in ("_row", "_source", "_epoch", "_last"))
    tagged = pin(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plan, _ = mixing_plan(tagged, id_column, source, text, seed=seed, row_column=row, **limits)
    last = plan.groupBy("source").agg(F.max(F.struct("epoch", "key", "n_tokens", "row")).alias("last"))
    # written first, so that the join knows its size: one row for each source is sent to the texts while that is small
    cuts = pin(last.select(F.col("source").alias(source_key), F.col("last").alias(cut)), "cuts")
    known = tagged.withColumn(source_key, F.coalesce(F.col(source).cast("string"), F.lit("")))
    copies = known.join(cuts, source_key).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(cut)["epoch"])))
    key = _key(seed, F.col(epoch), F.col(id_column), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    place = F.struct(F.col(epoch).alias("epoch"), key.alias("key"), n_tokens(text).alias("n_tokens"), F.col(row).alias("row"))
    return copies.where((F.col(epoch) < F.col(cut)["epoch"]) | (place <= F.col(cut))).select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    plan, weights = mixing_plan(table(spark, sf_dir, "documents"))
    named = weights.select("source", F.round("weight", 9).alias("weight"))
    return plan.join(named, "source").select(F.col("id").alias("doc_id"), "source", "n_tokens", "epoch", "block", "position", "weight")


def _rounds_sql() -> str:
    parts, before = [], "SELECT cast(0 AS DOUBLE) AS low, cast(1 AS DOUBLE) AS high"
    for r in range(ROUNDS):
        parts.append(f"""
b{r} AS ({before}),
t{r} AS (SELECT low + (high - low) * k / {CUTS} AS a FROM b{r}, range(0, {CUTS}) x(k)),
h{r} AS (SELECT a, sum(pow(p, a)) AS z, sum(pow(p, a) * ln(p)) AS l FROM shares, t{r} GROUP BY a),
f{r} AS (SELECT coalesce(min(a), (SELECT high FROM b{r})) AS best FROM h{r}, facts
         WHERE ln(z) - a * l / z <= {TARGET_ENTROPY} * ln(n) + 1e-12 AND pow(largest / least, 1 - a) <= {MAX_REPEATS})""")
        before = (f"SELECT coalesce((SELECT max(a) FROM t{r}, f{r} WHERE a < best), (SELECT low FROM b{r})) AS low, "
                  f"coalesce((SELECT best FROM f{r}), (SELECT high FROM b{r})) AS high")
    parts.append(f"\nexponent AS (SELECT high AS a FROM ({before}))")
    return ",".join(parts)


def _key_sql(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"coalesce(cast({p} AS VARCHAR), '')" for p in parts) + ")"


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS n_tokens,
    md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, cast(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
facts AS (SELECT sum(tokens) AS total, cast(max(tokens) AS DOUBLE) AS largest, cast(min(tokens) AS DOUBLE) AS least, count(*) AS n FROM s),
shares AS (SELECT source, tokens, tokens / cast(total AS DOUBLE) AS p FROM s, facts),{_rounds_sql()},
raw AS (SELECT *, pow(p, a) AS raw FROM shares, exponent),
sums AS (SELECT sum(raw) AS z, max(tokens / raw) AS need FROM raw),
w AS (SELECT source, tokens, raw / z AS weight, cast(floor(raw / z * (need * z) + 0.5) AS BIGINT) AS quota FROM raw, sums),
blocks AS (SELECT greatest(1, cast(ceil(sum(quota) / {BLOCK_TOKENS}) AS BIGINT)) AS n_blocks FROM w),
copies AS (
  SELECT *, {_key_sql(str(SEED), 'epoch', 'doc_id', 'digest')} AS key
  FROM (SELECT d.*, tokens, quota, weight,
          unnest(range(0, greatest(cast(ceil(quota / cast(tokens AS DOUBLE)) AS BIGINT), 1))) AS epoch
        FROM d JOIN w USING (source))),
placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM copies),
dealt AS (
  SELECT *, cast(least(floor(start * (cast(n_blocks AS DOUBLE) / quota)), n_blocks - 1) AS BIGINT) AS block
  FROM placed, blocks WHERE start < quota)
SELECT doc_id, source, n_tokens, cast(epoch AS BIGINT) AS epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY {_key_sql(str(SEED), "'block'", 'epoch', 'doc_id')}, n_tokens, key) AS position,
  round(weight, 9) AS weight
FROM dealt
"""
