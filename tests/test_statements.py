"""Each class of statement that must be refused, before and after analysis, and ordinary ones that must run."""

import pytest
from pyspark.errors import ParseException

from tessera.operators import ask as A
from tessera.operators import statements as S


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "file")
    spark.createDataFrame([(1, 2, "a"), (3, 4, "b"), (5, None, None)], "n int, m int, s string").createOrReplaceTempView("asked")
    spark.createDataFrame([(1, "other")], "n int, s string").createOrReplaceTempView("other")
    spark.createDataFrame([("secret",)], "s string").write.text(path)
    spark.udf.register("mine", lambda n: n, "int")
    spark.sql("CREATE TABLE stored_table USING parquet AS SELECT 1 AS n")
    yield path
    spark.sql("DROP TABLE stored_table")
    spark.sql("DROP TEMPORARY FUNCTION mine")


REFUSED = {
    "script": "SELECT TRANSFORM(n) USING 'cat' AS (x) FROM asked",
    "script of a map clause": "FROM asked MAP n USING 'cat' AS x",
    "file by path": "SELECT * FROM text.`{path}`",
    "file by identifier": "SELECT * FROM IDENTIFIER('text.`{path}`')",
    "function by identifier": "SELECT IDENTIFIER('reflect')('java.lang.System', 'nanoTime') FROM asked",
    "any identifier clause": "SELECT IDENTIFIER('upper')(s) FROM asked",
    "java": "SELECT reflect('java.lang.System', 'nanoTime')",
    "java in a lambda": "SELECT transform(array(1), x -> java_method('java.lang.System', 'nanoTime'))",
    "java that may fail": "SELECT try_reflect('java.lang.System', 'nanoTime')",
    "function of a catalog": "SELECT system.builtin.reflect('java.lang.System', 'nanoTime')",
    "descriptor file": "SELECT from_protobuf(binary(s), 'x', '{path}') FROM asked",
    "session": "SELECT current_user(), s FROM asked",
    "input file": "SELECT input_file_name() FROM asked",
    "own function": "SELECT mine(n) FROM asked",
    "catalog table": "SELECT * FROM stored_table",
    "catalog table behind an inner name": "SELECT o.* FROM (WITH stored_table AS (SELECT 1) SELECT * FROM stored_table) i, stored_table o",
    "catalog table in full": "SELECT * FROM default.stored_table",
    "table function": "SELECT * FROM python_worker_logs()",
    "list of the system": "SELECT * FROM sql_keywords()",
    "time travel": "SELECT * FROM asked VERSION AS OF 1",
    "hint": "SELECT /*+ REPARTITION(100000) */ * FROM asked",
    "parameter": "SELECT :p FROM asked",
    "insert": "INSERT INTO asked VALUES (1, 2, 'x')",
    "insert after a name": "WITH a AS (SELECT 1) INSERT OVERWRITE DIRECTORY '{path}' USING parquet SELECT * FROM a",
    "insert of a from clause": "FROM asked INSERT INTO t SELECT *",
    "set": "SET spark.sql.ansi.enabled=true",
    "add a jar": "ADD JAR '{path}'",
    "drop": "DROP VIEW asked",
    "two statements": "SELECT 1; SELECT 2",
    "execute": "EXECUTE IMMEDIATE 'SELECT 1'",
    "script block": "BEGIN SELECT 1; END",
    "explain": "EXPLAIN SELECT 1",
}


@pytest.mark.parametrize("kind", REFUSED)
def test_refused(spark, views, kind):
    text = REFUSED[kind].format(path=views)
    assert A.ask(spark, text) == (None, A.FAILED_MSG)
    with pytest.raises((S.NotAQuery, ParseException)):
        S.run_query(spark, text)
    assert spark.table("asked").count() == 3


ACCEPTED = [
    "SELECT n, m + 1 AS k, -n, n BETWEEN 1 AND 3, s LIKE 'a%', s || 'x', n::string, CASE WHEN m IS NULL THEN 0 ELSE m END FROM asked",
    "SELECT s, count(*), sum(m) FILTER (WHERE n > 1), count(DISTINCT n), percentile(n, 0.5) FROM asked GROUP BY ROLLUP(s) HAVING count(*) > 0",
    "SELECT n, row_number() OVER w, lag(n) OVER (PARTITION BY s ORDER BY n), sum(n) OVER (ORDER BY n ROWS 1 PRECEDING) FROM asked WINDOW w AS (ORDER BY n)",
    "SELECT * FROM (SELECT n, s FROM asked) PIVOT (count(n) FOR s IN ('a', 'b'))",
    "SELECT * FROM (SELECT n, m FROM asked) UNPIVOT (v FOR k IN (n, m))",
    "SELECT a.n, b.s FROM asked a LEFT JOIN asked b ON a.n = b.n WHERE a.n IN (SELECT n FROM asked) AND EXISTS (SELECT 1 FROM asked c WHERE c.n = a.n)",
    "SELECT n, x FROM asked LATERAL VIEW explode(array(n, m)) t AS x ORDER BY n NULLS LAST LIMIT 2 OFFSET 1",
    "SELECT * FROM asked, LATERAL (SELECT n + 1 AS o)", "SELECT * FROM explode(array(1, 2))", "SELECT id FROM range(3)", "TABLE asked",
    "SELECT * EXCEPT (n) FROM asked UNION ALL SELECT 1, 'x' INTERSECT SELECT 2, 'y'", "VALUES (1, 'a'), (2, 'b')",
    "WITH a AS (SELECT n FROM asked), b AS (SELECT max(n) AS n FROM a) SELECT * FROM a, b WHERE a.n = b.n",
    "SELECT transform(array(n), x -> x + 1), named_struct('a', n).a, map('k', n)['k'], try_cast(s AS int), typeof(n) FROM asked",
    "SELECT date_trunc('day', timestamp '2024-01-02 03:04:05'), date '2024-01-01' + interval 1 day, to_json(struct(n)), json_tuple('{}', 'a') FROM asked",
    "SELECT regexp_replace(s, 'a', 'b'), upper(s), coalesce(s, ''), n % 2, n DIV 2, stddev(n) OVER () FROM asked", "SELECT n FROM asked TABLESAMPLE (2 ROWS)",
    "WITH RECURSIVE r(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM r WHERE k < 3) SELECT * FROM r",
]


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(spark, views, text):
    if "RECURSIVE" in text:
        with pytest.raises(S.NotAQuery):                        # a recursion has no bound known beforehand
            S.run_query(spark, text)
    else:
        S.run_query(spark, text).collect()


def test_only_the_named_views_are_read(spark, views):
    text = "SELECT a.n FROM asked a JOIN other o ON a.n = o.n"
    assert A.ask(spark, text, views=["asked"]) == (None, A.FAILED_MSG)
    assert A.ask(spark, text, views=["asked", "other"])[0].collect() == A.ask(spark, text)[0].collect()
    own = "WITH other AS (SELECT 9 AS n) SELECT n FROM other"   # a name of its own, not the view
    assert [r.n for r in A.ask(spark, own, views=["asked"])[0].collect()] == [9]


def test_views_may_be_made_of_what_a_statement_may_not_use(spark, views):
    spark.read.text(views).selectExpr("value", "input_file_name() AS f").createOrReplaceTempView("lines")
    assert [r.value for r in A.ask(spark, "SELECT value FROM lines")[0].collect()] == ["secret"]
