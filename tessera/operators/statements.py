"""Which statements may run: one query over registered views, made of known parts only.

A statement is text from a model, so whatever is not known to be harmless is refused. It is checked twice: as parsed,
before Spark resolves any name (resolving a path would already read files), and as analysed, where every relation and
function stands resolved. Both checks hold lists of what is allowed; a kind of node that Spark adds later is refused.

- Operators: projections, filters, joins, groups, sorts, limits, windows, set operations, pivots, generators, CTEs.
- Functions: Spark's own, by name and in one part, of the groups in ``FUNCTION_GROUPS`` and the few in ``FUNCTIONS``;
  none that call Java, run user code, read files or descriptors, or tell of the session.
- Relations: temporary views, or only those named in ``views``, names the statement defines itself, rows written out in
  it, and ``range``. Their own definitions are the caller's, and are not looked into.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_QUERY_START = re.compile(r"^\s*(\(\s*)*(SELECT|WITH|VALUES|TABLE|FROM)\b", re.IGNORECASE)
_CATALYST = "org.apache.spark.sql.catalyst."

FUNCTION_GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs "
    "generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs string_funcs struct_funcs "
    "url_funcs variant_funcs window_funcs".split())
FUNCTIONS = frozenset("typeof case".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack".split())
REFUSED_FUNCTIONS = frozenset("collations sql_keywords".split())          # of the groups above, these list the system's tables

#: operators of the parsed and of the analysed plan, by class name
_SHARED = ("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join LateralJoin "
           "SubqueryAlias OneRowRelation LocalRelation Window Generate Pivot Unpivot Expand Sample").split()
PARSED = frozenset(_SHARED + ("UnresolvedRelation UnresolvedWith UnresolvedInlineTable UnresolvedHaving WithWindowDefinition "
                              "UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases").split())
ANALYSED = frozenset(_SHARED + "WithCTE CTERelationDef CTERelationRef Range View Deduplicate".split())
#: expressions that are still names
_NAMES = frozenset(
    "UnresolvedAttribute UnresolvedFunction UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedAlias UnresolvedExtractValue "
    "UnresolvedOrdinal UnresolvedGenerator MultiAlias UnresolvedInlineTable UnresolvedSubqueryColumnAliases".split())
#: expression packages; of the first, classes that call user code or Java, or tell of files and tasks, are refused
_EXPRESSIONS = tuple(_CATALYST + "expressions." + p for p in ("", "aggregate.", "variant."))
_REFUSED = frozenset(
    "CallMethodViaReflection ScalaUDF PythonUDF PythonUDAF PythonUDTF UnresolvedPolymorphicPythonUDTF InputFileName "
    "InputFileBlockStart InputFileBlockLength SparkPartitionID MonotonicallyIncreasingID RaiseError AesEncrypt AesDecrypt "
    "CurrentUser CurrentCatalog CurrentDatabase SessionUser SparkVersion TryReflect PipeOperator".split())


class NotAQuery(ValueError):
    """The statement is not one query over registered views."""


def _items(seq):
    """The elements of a Scala sequence."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


class _Walk:
    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.catalog = spark._jsparkSession.sessionState().catalog()
        of = lambda name: self.jvm.java.lang.Class.forName(_CATALYST + name)
        self.plan, self.holds_plan = of("plans.logical.LogicalPlan"), of("expressions.PlanExpression")

    def nodes(self, root, below=lambda node, name: True):
        """Every operator and expression: (node, whether it is an operator, class name)."""
        todo = [root]
        while todo:
            node = todo.pop()
            name = node.getClass().getName()
            is_plan = self.plan.isInstance(node)
            yield node, is_plan, name
            if is_plan and not below(node, name.rsplit(".", 1)[-1]):
                continue
            if is_plan:
                todo += _items(node.expressions())
            elif self.holds_plan.isInstance(node):
                todo.append(node.plan())
            todo += _items(node.children())

    def check_function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if len(parts) > 1:
            raise NotAQuery(f"function {'.'.join(parts)} is refused")
        known = self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
        info = self.catalog.lookupFunctionInfo(known) if self.catalog.functionExists(known) else None
        if info is None:
            raise NotAQuery(f"no such function: {name}")
        allowed = (info.getGroup() in FUNCTION_GROUPS or name in FUNCTIONS) and name not in REFUSED_FUNCTIONS
        if info.getSource() != "built-in" or not allowed:
            raise NotAQuery(f"function {name} is refused")


def _check_expression(name: str, names_allowed: bool) -> None:
    package, short = name.rsplit(".", 1)
    if names_allowed and package == _CATALYST + "analysis" and short in _NAMES:
        return
    if package + "." not in _EXPRESSIONS or short.split("$")[0] in _REFUSED:
        raise NotAQuery(f"{short} is refused")


def check_query(stmt: str, spark: SparkSession | None = None, views=None) -> str:
    """The statement, if its parsed form is one allowed query; names are looked up, nothing is resolved or run."""
    s = (stmt or "").strip().rstrip(";").strip()
    if not _QUERY_START.match(s):
        raise NotAQuery(f"only one query statement is accepted: {s[:80]!r}")
    spark = spark or SparkSession.getActiveSession()
    walk = _Walk(spark)
    allowed = None if views is None else {v.lower() for v in views}
    relations, defined, more = [], set(), [spark._jsparkSession.sessionState().sqlParser().parsePlan(s)]
    while more:
        for node, is_plan, name in walk.nodes(more.pop()):
            short = name.rsplit(".", 1)[-1]
            if not is_plan:
                _check_expression(name, True)
                if short == "UnresolvedFunction":
                    walk.check_function(list(_items(node.nameParts())))
                elif short == "UnresolvedGenerator":
                    walk.check_function([node.name().funcName()])
            elif short not in PARSED:
                raise NotAQuery(f"not a query: {short}")
            elif short == "UnresolvedRelation":
                relations.append(list(_items(node.multipartIdentifier())))
            elif short == "UnresolvedWith":
                for named in _items(node.cteRelations()):
                    defined.add(named._1().lower())
                    more.append(named._2())
            elif short == "UnresolvedTableValuedFunction":
                parts = list(_items(node.name()))
                if len(parts) != 1 or parts[0].lower() not in TABLE_FUNCTIONS:
                    raise NotAQuery(f"table function {'.'.join(parts)} is refused")
    for parts in relations:
        name = parts[0].lower()
        registered = walk.catalog.getTempView(parts[0]).isDefined() and (allowed is None or name in allowed)
        if len(parts) != 1 or not (name in defined or registered):
            raise NotAQuery(f"no registered view: {'.'.join(parts)}")
    return s


def check_analysed(df: DataFrame, views=None) -> DataFrame:
    """The query, if its analysed plan is made of allowed operators and expressions over registered views."""
    spark = df.sparkSession
    walk = _Walk(spark)
    allowed = None if views is None else {v.lower() for v in views}
    root = df._jdf.queryExecution().analyzed()
    # a view's own plan is its owner's
    for node, is_plan, name in walk.nodes(root, lambda node, short: short != "View"):
        short = name.rsplit(".", 1)[-1]
        if not is_plan:
            _check_expression(name, False)
        elif short not in ANALYSED:
            raise NotAQuery(f"not a query: {short}")
        elif short == "View":
            view = node.desc().identifier().table()
            if not node.isTempView() or not (allowed is None or view.lower() in allowed):
                raise NotAQuery(f"no registered view: {view}")
    return df


def run_query(spark: SparkSession, stmt: str, views=None) -> DataFrame:
    """The statement as a DataFrame, if both checks hold."""
    return check_analysed(spark.sql(check_query(stmt, spark, views)), views)
