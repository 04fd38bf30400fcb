"""Line dedup: repeated runs of lines are found on line-ID sequences and their later copies deleted.

Line ids are ranks of the repeated lines (a unique line cannot be part of a repeated run). Distributed prefix doubling then
ranks the blocks of 2, 4, 8... lines: the pair of a block's two halves is sorted and ranked by a range shuffle, and blocks
found once drop out. Blocks of equal rank are an LCP interval of that depth in the suffix order, and its least position is
the first copy.

A run of lines is repeated if the same lines come earlier (by id, then as read, then by position) and it has at least
``MIN_WORDS`` words. Every line of such a run lies in a shortest run that reaches the limit and starts, or ends, at some
line; how long that is depends on the lines alone, so equal shortest runs have equal lengths. Two blocks of one level that
cover it name it. A line is deleted iff a repeated run holds it. Rounds go no further than the longest shortest run.

The documents are read once: numbered and written to the shared folder, from which both their lines and the result are taken,
so a number means the same document in both whatever the input and however it is split. Null and empty texts have no lines and stay as they are. A null id sorts first. Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, pin, table
from tessera.operators.scans import in_parts, running

MIN_WORDS = 10


def _ranked(groups: DataFrame, *keys: str) -> DataFrame:
    """A rank in key order: ids rise with the range partition and with the place inside it."""
    return pin(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _lines(docs: DataFrame, doc: str, id_column: str, text: str, min_words: int) -> DataFrame:
    """One row per line: doc, id, pos, line (digest), and the shortest runs that start and end there (null: none)."""
    lines = docs.select(F.col(doc).alias("doc"), F.col(id_column).alias("id"),
                        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc", "id", "pos", F.md5("line").alias("line"),
                         F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    in_doc = Window.partitionBy("doc").orderBy("pos")
    lines = lines.withColumn("upto", F.sum("words").over(in_doc)).withColumn("before", F.col("upto") - F.col("words"))
    whole = Window.partitionBy("doc")
    # of the lines far enough ahead the first; in falling order the frame only grows
    ahead = Window.partitionBy("doc").orderBy(-F.col("before")).rangeBetween(Window.unboundedPreceding, -min_words)
    behind = Window.partitionBy("doc").orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    lines = lines.withColumn("total", F.max("upto").over(whole)).withColumn("n", F.count("*").over(whole))
    stop = F.coalesce(F.min("pos").over(ahead), F.when(F.col("total") - F.col("before") >= min_words, F.col("n").cast("int")))
    start = F.coalesce(F.max("pos").over(behind) + 1, F.when(F.col("upto") >= min_words, F.lit(0)))
    return lines.withColumn("size_after", stop - F.col("pos")).withColumn("from", start) \
        .select("doc", "id", "pos", "line", "size_after", "from")


def repeated_lines(docs: DataFrame, doc: str, id_column: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, begins, ends: the lines to delete, from each begin up to before its end, in disjoint spans by position; the
    column ``doc`` is a unique number that rises as rows are read."""
    lines = pin(_lines(docs, doc, id_column, text, min_words), "lines")
    found = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
    level = pin(lines.join(_ranked(found.select("line"), "line"), "line").select("doc", "pos", "rank"), "blocks")
    usable = lines.join(level.select("doc", "pos"), ["doc", "pos"])       # a shortest run starts and ends with repeated lines
    runs = usable.where("size_after is not null").select("id", "doc", F.col("pos").alias("start"), F.col("size_after").alias("size")) \
        .unionByName(usable.where(F.col("from").isNotNull()).select("id", "doc", F.col("from").alias("start"),
                                                                   (F.col("pos") - F.col("from") + 1).alias("size"))).distinct()
    runs = pin(runs.withColumn("level", F.floor(F.log2("size") + 1e-9).cast("int")), "runs")
    levels, top = [level], runs.agg(F.max("level")).head()[0] or 0
    for k in range(1, top + 1):
        first = levels[-1]
        second = first.select("doc", (F.col("pos") - (1 << (k - 1))).alias("pos"), F.col("rank").alias("next"))
        pairs = pin(first.join(second, ["doc", "pos"]), "pairs")
        again = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").select(
            F.col("rank").alias("half"), "next")
        named = _ranked(again, "half", "next")
        levels.append(pin(pairs.withColumnRenamed("rank", "half").join(named, ["half", "next"]).select("doc", "pos", "rank"), "blocks"))
    later = None
    for k, level in enumerate(levels):
        own = runs.where(F.col("level") == k)
        begin = level.select("doc", F.col("pos").alias("start"), F.col("rank").alias("begin"))
        end = level.select("doc", F.col("pos").alias("tail"), F.col("rank").alias("end"))
        named = own.join(begin, ["doc", "start"]).withColumn("tail", F.col("start") + F.col("size") - (1 << k)).join(end, ["doc", "tail"])
        place = F.struct("id", "doc", "start")
        firsts = named.groupBy("begin", "end", "size").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        copies = named.join(firsts, ["begin", "end", "size"]).where(place > F.col("first")).select(
            "doc", "start", (F.col("start") + F.col("size")).alias("stop"))
        later = copies if later is None else later.unionByName(copies)
    return _spans(later)


def _spans(runs: DataFrame) -> DataFrame:
    """The union of the runs (doc, start, stop) of each document: a run adds one where it starts and takes one off where it
    stops; lines are covered where the running sum is not nought. No run is expanded into its lines."""
    change = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("step"))))
    steps = runs.select("doc", change.alias("c")).groupBy("doc", "c.pos").agg(F.sum("c.step").alias("step")).where("step <> 0")
    covered = running(in_parts(steps, ["doc"], ["pos"]), {"cover": ("sum", "step")})
    opens, closes = (F.col("cover") > 0) & (F.col("cover") == F.col("step")), F.col("cover") == 0
    return covered.groupBy("doc").agg(F.sort_array(F.collect_list(F.when(opens, F.col("pos")))).alias("begins"),
                                      F.sort_array(F.collect_list(F.when(closes, F.col("pos")))).alias("ends"))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut out of ``text``, and a column ``deleted_lines`` (replaced if there)."""
    doc, begins, ends = (free_name(docs, x) for x in ("_doc", "_begins", "_ends"))
    tagged = pin(docs.withColumn(doc, F.monotonically_increasing_id()), "docs")
    spans = repeated_lines(tagged, doc, id_column, text, min_words).select(
        F.col("doc").alias(doc), F.col("begins").alias(begins), F.col("ends").alias(ends))

    def without_spans(lines):
        # what stands between the spans, each piece sliced once
        pieces = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col(ends)).alias("a"), F.concat(F.col(begins), F.array(F.size(lines))).alias("b"))
        return F.array_join(F.flatten(F.transform(pieces, lambda p: F.slice(lines, p["a"] + 1, p["b"] - p["a"]))), "\n")

    kept = F.transform(F.array(F.split(text, "\n")), without_spans)[0]   # the text is split once
    size = F.aggregate(F.arrays_zip(F.col(begins).alias("a"), F.col(ends).alias("b")), F.lit(0).cast("bigint"), lambda n, p: n + p["b"] - p["a"])
    return tagged.join(spans, doc, "left").withColumn(text, F.when(F.col(begins).isNull(), F.col(text)).otherwise(kept)) \
        .withColumn("deleted_lines", F.coalesce(size, F.lit(0)).cast("bigint")) \
        .select(*[c for c in docs.columns if c != "deleted_lines"], "deleted_lines")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "deleted_lines", F.length("text").cast("bigint").alias("chars_left"), F.md5("text").alias("text_md5"))


OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line, lines
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
b AS (SELECT *, upto - words AS before FROM c),
runs AS (
  SELECT x.doc_id, x.pos AS start, min(y.pos) AS stop, any_value(x.lines) AS lines
  FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.pos >= x.pos AND y.upto - x.before >= {MIN_WORDS} GROUP BY x.doc_id, x.pos
  UNION
  SELECT y.doc_id, max(x.pos) AS start, y.pos AS stop, any_value(x.lines) AS lines
  FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.pos >= x.pos AND y.upto - x.before >= {MIN_WORDS} GROUP BY y.doc_id, y.pos),
named AS (
  SELECT doc_id, start, stop, row_number() OVER (PARTITION BY list_slice(lines, start + 1, stop + 1) ORDER BY doc_id, start) AS nth FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS pos FROM named WHERE nth > 1),
kept AS (
  SELECT l.doc_id, count(gone.pos) AS deleted_lines,
    coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT doc_id, coalesce(deleted_lines, 0) AS deleted_lines, length(kept.text) AS chars_left, md5(kept.text) AS text_md5
FROM documents LEFT JOIN kept USING (doc_id)
"""
