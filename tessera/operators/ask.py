"""Table questions: peek, one statement over registered views, report, recipes, dataset catalog.

A question's answer is one Spark SQL query (the statement a model writes
instead of pandas source). Only queries made of known parts over registered
views are accepted (see ``statements``); anything else is refused before it
reaches ``spark.sql``, which would run a command at once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import TRUNCATE_MARKER
from tessera.operators.statements import NotAQuery, run_query
from tessera.session import pinned, read_if_there

# Fixed values that must equal the reference's for right results.
FAILED_MSG = "Failed to process your request in a valid expression after several attempts."
PEEK_ROWS = 5
REPORT_TEXT = ("Executing the expression: {statement} saved as {name} produced the following table:\n"
               "\nDataframe {n} first rows\n{table}\n\n\nNumber of Records: {records}\n")
PEEK_TEXT = ("The uploaded table contains : {records} records.\n "
             "Here follows the headers and first 4 rows :\n{table}")
MAX_ATTEMPTS = 2
VALUE_CHARS = 2000      # a value's text in a report; tables are not cut
RECIPE_DESCRIPTION = "description: "


def unwrap_statement(text: str, key: str = "df") -> str:
    """B8 on the driver: ``{"df": "..."}`` -> its field, else the stripped text."""
    import json

    try:
        parsed = json.loads(text)
    except (TypeError, ValueError):
        return (text or "").strip()
    if isinstance(parsed, dict):
        v = parsed.get(key, "")
        return v if isinstance(v, str) else json.dumps(v)
    return (text or "").strip()


# I1 ------------------------------------------------------------------------
def peek(df: DataFrame, order, n: int = PEEK_ROWS) -> DataFrame:
    """Record count and the first ``n`` rows in ``order``.

    The count is one distributed aggregate; the first rows come from
    TakeOrderedAndProject. Both are bounded on the driver.
    """
    order = [order] if isinstance(order, str) else list(order)
    n_records = df.count()
    return df.orderBy(*order).limit(n).withColumn("n_records", F.lit(n_records).cast("bigint"))


# I2 ------------------------------------------------------------------------
def ask(spark: SparkSession, statement, repair=None, attempts: int = MAX_ATTEMPTS, views=None):
    """Run one statement over the registered views (only ``views``, where given).

    ``statement`` may be wrapped as ``{"df": "..."}``, or be a list of
    candidate statements tried in order (the first that analyses wins). When
    it fails to analyse, ``repair(statement, error_text)`` may propose a new
    one, up to ``attempts`` tries in all. Returns ``(DataFrame, statement)`` or
    ``(None, FAILED_MSG)``.
    """
    if isinstance(statement, (list, tuple)):
        for cand in statement:
            df, stmt = ask(spark, cand, None, 1, views)
            if df is not None:
                return df, stmt
        return ask(spark, statement[-1], repair, attempts, views) if statement and repair else (None, FAILED_MSG)
    stmt = unwrap_statement(statement)
    for i in range(attempts):
        try:
            return run_query(spark, stmt, views), stmt
        except (AnalysisException, ParseException, NotAQuery) as e:
            if repair is None or i + 1 >= attempts:
                break
            stmt = unwrap_statement(repair(stmt, str(e)))
    return None, FAILED_MSG


# I4 ------------------------------------------------------------------------
def nunique(df: DataFrame, written: bool = False) -> DataFrame:
    """I4: distinct non-null values per column, one row per column.

    Each column is counted alone, over a scan of that column: rows are not multiplied by columns, and what is shuffled is a
    task's distinct values. A table that is not ``written`` is written first, so that it is computed once.
    """
    from functools import reduce

    rows = df if written else pinned(df, "counted")
    counts = [rows.agg(F.countDistinct(F.col(f"`{c}`")).alias("n_distinct")).select(F.lit(c).alias("column_name"), "n_distinct") for c in df.columns]
    return reduce(DataFrame.unionByName, counts)


# I3 ------------------------------------------------------------------------
def markdown_table(columns, rows) -> str:
    """A few rows as a markdown table (the text shown to a model or a user)."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return head + "".join("| " + " | ".join(str(v) for v in r) + " |\n" for r in rows)


def report(df: DataFrame, statement: str, name: str, n: int = PEEK_ROWS, written: bool = False) -> dict:
    """Statement, saved name, record count, first rows and distinct counts.

    Everything returned to the driver is bounded: one count, ``n`` rows and one
    number per column.
    """
    rows = [r.asDict() for r in df.limit(n).collect()]
    counts = {r["column_name"]: r["n_distinct"] for r in nunique(df, written).collect()}
    n_records = df.count()
    table = markdown_table(df.columns, [list(r.values()) for r in rows])
    text = REPORT_TEXT.format(statement=statement, name=name, n=n, table=table, records=n_records)
    return {"statement": statement, "name": name, "n_records": n_records, "head": rows, "nunique": counts,
            "text": text}


def value_text(df: DataFrame, statement: str) -> str | None:
    """I3 for a result of one column: one row is a value, more rows a list of values; ``None`` for a table."""
    if len(df.columns) != 1:
        return None
    rows = [str(r[0]) for r in df.limit(VALUE_CHARS + 1).collect()]      # each takes a character at least
    text = rows[0] if len(rows) == 1 else "\n".join(rows)
    if len(text) > VALUE_CHARS:
        text = text[:VALUE_CHARS] + TRUNCATE_MARKER
    return f"Executing the expression: {statement} produced the following result:\n{text}"


def answer(spark: SparkSession, statement: str, save_to: str, repair=None, attempts: int = MAX_ATTEMPTS,
           views=None) -> tuple[str, str | None]:
    """I2 and I3 for one statement: (report text, where the result table was saved).

    The result is written once and the report is taken from what was written. An error of any kind, while the statement is
    read, planned or run, is given to ``repair(statement, error)``; after ``attempts`` tries the fixed text is the answer.
    """
    stmt = unwrap_statement(statement)
    for i in range(attempts):
        path = f"{save_to}-{i}"
        try:
            run_query(spark, stmt, views).write.parquet(path)
            saved = spark.read.parquet(path)
            return value_text(saved, stmt) or report(saved, stmt, "last_result", written=True)["text"], path
        except Exception as problem:  # noqa: BLE001 - whatever the statement does is its own fault
            if repair is None or i + 1 >= attempts:
                break
            stmt = unwrap_statement(repair(stmt, str(problem).split("JVM stacktrace")[0][:500]))
    return FAILED_MSG, None


# I5 ------------------------------------------------------------------------
RECIPE_SCHEMA = "recipe string, step_no int, input string, action string, option string, next_df string"


def recipe_rows(spark: SparkSession, recipe: str, prompt: str, statement: str, start: int = 0) -> DataFrame:
    """The two rows a saved question adds to the recipe log."""
    rows = [(recipe, start, RECIPE_DESCRIPTION + prompt, "ReuseDf", "", "next"),
            (recipe, start + 1, statement, "execute_df_expression", "", "next")]
    return spark.createDataFrame(rows, RECIPE_SCHEMA)


def save_recipe(spark: SparkSession, log_path: str, recipe: str, prompt: str, statement: str) -> None:
    """Append to the recipe log (one parquet table)."""
    log = read_if_there(spark, log_path)
    start = 0 if log is None else log.filter(F.col("recipe") == recipe).count()
    recipe_rows(spark, recipe, prompt, statement, start).write.mode("append").parquet(log_path)


def replay(spark: SparkSession, log_path: str, recipe: str, result_view: str = "last_result") -> DataFrame:
    """Run a recipe's statements in order; each result becomes ``result_view``
    for the next step (A5). The steps (a few rows) are read to the driver."""
    steps = (spark.read.parquet(log_path).filter((F.col("recipe") == recipe)
                                                & (F.col("action") == "execute_df_expression"))
             .orderBy("step_no").select("input").collect())
    out = None
    for (stmt,) in steps:
        out, msg = ask(spark, stmt)
        if out is None:
            raise ValueError(msg)
        out.createOrReplaceTempView(result_view)
    return out


# I6 ------------------------------------------------------------------------
def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: sum of row hashes and the row count.

    ``xxhash64`` of every row summed as decimal (a repeated row adds twice, so
    it is not cancelled as with xor); one partial aggregate per task.
    """
    return df.agg(F.sum(F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")).cast("string")
                  .alias("fingerprint"), F.count("*").alias("n_rows"))


def register_dataset(df: DataFrame, catalog: DataFrame | None, name: str) -> DataFrame:
    """The catalog row to add if the table's fingerprint is new, else nothing."""
    row = fingerprint(df).withColumn("table_name", F.lit(name)).select("table_name", "fingerprint", "n_rows")
    if catalog is None:
        return row
    return row.join(catalog.select("fingerprint"), "fingerprint", "left_anti").select(
        "table_name", "fingerprint", "n_rows")
