"""Sources and sinks: delimited tables, step tables, text documents and the stores.

Stores are parquet folders under one root (by default the session's shared
checkpoint folder, see ``tessera.session.checkpoint_root``), one folder per
table; writing a table is also how a long lineage is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_COLUMNS = ("input", "action", "option", "next_df")
SEPARATORS = ("|", "\t", ",", ";")


# A1 ------------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None,
               schema=None, multi_line: bool = False) -> DataFrame:
    """A1: a delimited table with a header row.

    Types are inferred unless ``schema`` is given (inference is one extra pass
    over the files; pass a schema for large inputs). Large files are read in
    splits; ``multi_line`` lets quoted fields span lines, at one task per file.
    """
    reader = (spark.read.option("header", True).option("sep", sep).option("multiLine", multi_line)
              .option("encoding", encoding or "UTF-8").option("escape", '"'))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


# A2 ------------------------------------------------------------------------
def read_sequences(spark: SparkSession, path: str, glob: str = "*.csv", recursive: bool = True) -> DataFrame:
    """A2: every step table under ``path`` -> ``file, step_no, input, action, option, next_df``.

    Each file is read whole (a step table is a few lines) so row order is kept
    as ``step_no`` (0-based, header excluded). The separator is taken from the
    header line: the first of ``| tab , ;`` that splits it into the four
    column names. A field may be quoted (quotes inside doubled) and then hold
    separators and line breaks; an unquoted input may hold separators.
    """
    # wholetext goes to text() itself: its keyword default would override an option()
    raw = (spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
           .select(F.col("_metadata.file_path").alias("file"), F.col("value")))
    header = F.trim(F.regexp_extract("value", r"\A\s*([^\r\n]*)", 1))
    body = F.regexp_replace("value", r"\A\s*[^\r\n]*", "")
    fields = F.lit(None).cast("array<array<string>>")
    for sep in reversed(SEPARATORS):
        names = F.concat_ws(sep, *[F.lit(c) for c in STEP_COLUMNS])
        e = "\\t" if sep == "\t" else "\\" + sep
        quoted, end = r'"(?:[^"]++|"")*+"[ \t]*', r"(?=\r?\n|\z)"
        plain = rf'[^{e}\r\n"][^{e}\r\n]*|'
        record = rf'(?<=\n)({quoted}|[^\r\n]*?){e}({quoted}|{plain}){e}({quoted}|{plain}){e}({quoted}|{plain}){end}'
        found = F.array(*[F.regexp_extract_all(body, F.lit(record), F.lit(i)) for i in range(1, 5)])
        fields = F.when(header == names, found).otherwise(fields)

    def plain_text(c):
        inner = F.replace(F.regexp_extract(c, r'(?s)\A[ \t]*"(.*)"[ \t]*\z', 1), F.lit('""'), F.lit('"'))
        return F.trim(F.when(c.rlike(r'(?s)\A[ \t]*".*"[ \t]*\z'), inner).otherwise(c))

    rows = raw.select("file", fields.alias("f")).select("file", F.posexplode(F.arrays_zip(
        *[F.col("f")[i].alias(c) for i, c in enumerate(STEP_COLUMNS)])).alias("step_no", "r"))
    return rows.select("file", "step_no", *[plain_text(F.col("r")[c]).alias(c) for c in STEP_COLUMNS])


def write_sequences(df: DataFrame, path: str, name_col: str = "recipe", order_col: str = "step_no",
                    sep: str = "|") -> None:
    """Write step rows as step-table files, one folder per ``name_col`` value, header first.

    Fields that hold the separator, quotes or line breaks are quoted. A step
    table is a few rows, so each table's text is assembled with one bounded
    ``collect_list`` per name and written as one file.
    """
    def field(c):
        text = F.coalesce(F.col(c), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[\r\n"]') | F.contains(text, F.lit(sep)), quoted).otherwise(text)

    line = F.concat_ws(sep, *[field(c) for c in STEP_COLUMNS])
    text = df.groupBy(name_col).agg(F.concat_ws("\n", F.lit(sep.join(STEP_COLUMNS)), F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), line.alias("l")))),
        lambda s: s["l"])).alias("value"))
    text.write.mode("overwrite").partitionBy(name_col).text(path)


# A3 ------------------------------------------------------------------------
def decode_text(content) -> Column:
    """A3: bytes -> text. A UTF-16 byte-order mark decides UTF-16; else valid
    UTF-8 is read as UTF-8; anything else as ISO-8859-1."""
    b = F.col(content) if isinstance(content, str) else content
    bom = F.hex(F.substring(b, 1, 2))
    rest = F.substring(b, F.lit(3), F.length(b))
    return (F.when(bom == "FEFF", F.decode(rest, "UTF-16BE"))
            .when(bom == "FFFE", F.decode(rest, "UTF-16LE"))
            .when(F.is_valid_utf8(b.cast("string")), b.cast("string"))
            .otherwise(F.decode(b, "ISO-8859-1")))


def read_documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """A3: text files -> ``path, text``, decoding each file by the rule above."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
             .load(path))
    return files.select("path", decode_text("content").alias("text"))


# A4 / A5 / A6 --------------------------------------------------------------
def save_result(df: DataFrame, store: str, name: str, fmt: str = "parquet", sep: str = ",") -> str:
    """A4: write a result table under ``name`` (overwrite); returns its path."""
    path = f"{store.rstrip('/')}/{name}"
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("sep", sep).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def load_result(spark: SparkSession, store: str, name: str, view: str | None = "df",
                fmt: str = "parquet", sep: str = ",") -> DataFrame:
    """A5: a saved result as the active input (registered as ``view``)."""
    path = f"{store.rstrip('/')}/{name}"
    df = read_table(spark, path, sep) if fmt == "csv" else spark.read.format(fmt).load(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def append(df: DataFrame, store: str, table: str, partition_by=None) -> str:
    """Append rows to a store table (one folder per table)."""
    path = f"{store.rstrip('/')}/{table}"
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path
