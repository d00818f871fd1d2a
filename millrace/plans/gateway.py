"""Queries of one role: one SELECT over the role's tables, checked before it runs, capped and audited.

Two layers, each of which holds alone. The first looks at the statement: it is parsed without being run, and every node of
its plan has to be on a list of allowed ones, so that whatever Spark can do in a SELECT beyond relational algebra
(scripts, reflection, files, generators) is refused by default. The second, DataLayer, looks at what the statement
came to mean: it is analyzed, still without being run, in a session that holds nothing but the role's tables, and the
analyzed plan has to read these tables only, by instance and column, and to hold no command and no unlisted expression.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from ..sources import tables as sources
from .silver import AUDITED

MOST_ROWS = 1000
#: Nodes of plans and expressions that a statement may hold, by their class in Spark.
PLANS = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect",
    "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "OneRowRelation",
}
EXPRESSIONS = {
    "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "UnresolvedFunction", "UnresolvedOrdinal", "Literal", "Alias", "Cast", "SortOrder",
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "IsNull", "IsNotNull", "Like", "ILike", "RLike", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny",
    "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "CaseWhen", "Concat", "Between",
    "ScalarSubquery", "Exists", "InSubquery", "ListQuery", "WindowExpression", "UnresolvedWindowExpression", "WindowSpecDefinition", "WindowSpecReference",
    "SpecifiedWindowFrame", "UnspecifiedFrame$", "UnboundedPreceding$", "UnboundedFollowing$", "CurrentRow$", "Cube", "Rollup", "GroupingSets", "MultiAlias",
}
FUNCTIONS = {
    "abs", "add_months", "approx_count_distinct", "approx_percentile", "any_value", "array_join", "avg", "between", "bool_and", "bool_or", "cast", "ceil", "ceiling", "char_length", "coalesce", "concat", "concat_ws", "contains", "corr", "count", "count_if",
    "cume_dist", "date", "date_add", "date_diff", "date_format", "date_sub", "date_trunc", "datediff", "day", "dayofmonth", "dayofweek", "dense_rank", "endswith", "every", "extract", "first", "first_value", "floor", "greatest", "grouping", "grouping_id",
    "hour", "if", "ifnull", "isnotnull", "isnull", "lag", "last", "last_day", "last_value", "lead", "least", "left", "length", "ln", "log10", "lower", "ltrim", "max", "max_by", "mean", "median", "min", "min_by", "minute", "mod", "month", "months_between",
    "nth_value", "ntile", "nullif", "nvl", "percent_rank", "percentile", "percentile_approx", "power", "quarter", "rank", "regexp_replace", "replace", "right", "round", "row_number", "rtrim", "second", "sign", "some", "split_part", "sqrt", "startswith",
    "std", "stddev", "stddev_pop", "stddev_samp", "string", "substr", "substring", "sum", "to_date", "trim", "trunc", "try_cast", "try_divide", "upper", "var_pop", "var_samp", "variance", "weekofyear", "year",
}


#: Nodes of an analyzed plan; commands, generators, scripts, samples, hints and writers are none of them.
ANALYZED_PLANS = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "Window", "Expand", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect",
    "SubqueryAlias", "View", "WithCTE", "CTERelationDef", "CTERelationRef", "OneRowRelation",
}
#: Expressions of an analyzed plan besides those that FUNCTIONS stand for.
ANALYZED_EXPRESSIONS = {
    "AttributeReference", "OuterReference", "Literal", "Alias", "Cast", "SortOrder", "AggregateExpression", "WindowExpression", "WindowSpecDefinition", "SpecifiedWindowFrame", "UnspecifiedFrame$", "UnboundedPreceding$", "UnboundedFollowing$", "CurrentRow$",
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "Between", "In", "IsNull", "IsNotNull", "Like", "ILike", "RLike", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny",
    "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "BitwiseAnd", "ShiftRight", "DateAddInterval", "DateAddYMInterval", "TimestampAddInterval", "TimestampAddYMInterval", "SubtractDates", "SubtractTimestamps",
    "CaseWhen", "If", "Concat", "ScalarSubquery", "Exists", "InSubquery", "ListQuery",
}


class GatewayError(RuntimeError):
    """The gateway cannot serve this role."""


@dataclass
class Analysis:
    """What a statement is: its normal form and hash, and what it refers to."""

    normalized: str
    sql_hash: str
    tables: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    sensitive: list[str] = field(default_factory=list)


class NotReadOnly(RuntimeError):
    """What a statement means is not a read of the role's tables; the message names kinds of nodes and no value."""


class Denied(Exception):
    """A refused statement; the reason holds no value."""

    def __init__(self, reason: str, analysis: Analysis):
        super().__init__(reason)
        self.reason, self.analysis = reason, analysis


@dataclass
class Result:
    columns: list[str]
    rows: list[Row]
    analysis: Analysis


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_LEXER = re.compile(r"(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>`[^`]*`|[^\W\d]\w*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?\w*|\.\d+)|(?P<space>\s+)|(?P<other>.)", re.DOTALL)


def normal_form(sql: str) -> str:
    """The statement with every literal as ?, words in lower case, one space between tokens and no comments."""
    out = [("?" if m.lastgroup in ("text", "number") else m[0].lower()) for m in _LEXER.finditer(sql) if m.lastgroup not in ("comment", "space")]
    return " ".join(out).removesuffix(" ;").strip()


class _Plan:
    """A parsed or analyzed plan on the JVM side, as classes and attributes."""

    def __init__(self, spark: SparkSession):
        jvm = spark._jvm
        self.node = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.trees.TreeNode")
        self.plan = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")
        self.many = jvm.java.lang.Class.forName("scala.collection.Iterable")
        self.product = jvm.java.lang.Class.forName("scala.Product")

    @staticmethod
    def name(obj) -> str:
        return obj.getClass().getSimpleName()

    def walk(self, obj, parents: tuple[str, ...] = ()) -> Iterator[tuple[object, str, tuple[str, ...]]]:
        """Every tree node below obj, through sequences, options and tuples, with its class and its parents' classes."""
        if not hasattr(obj, "getClass"):
            return
        if self.node.isInstance(obj):
            own = self.name(obj)
            yield obj, own, parents
            for i in range(obj.productArity()):
                yield from self.walk(obj.productElement(i), (*parents, own))
        elif self.many.isInstance(obj):
            it = obj.iterator()
            while it.hasNext():
                yield from self.walk(it.next(), parents)
        elif self.product.isInstance(obj) and self.name(obj) in ("Some", "Tuple2", "Tuple3"):
            for i in range(obj.productArity()):
                yield from self.walk(obj.productElement(i), parents)


def _names(seq) -> list[str]:
    return [seq.apply(i) for i in range(seq.size())]


def check(spark: SparkSession, sql: str, tables: Mapping[str, Sequence[str]], sensitive: set[str] = frozenset(), limit: int = MOST_ROWS) -> Analysis:
    """The analysis of one SELECT over these tables; Denied if it is anything else. Nothing is run."""
    plans, parser = _Plan(spark), spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(sql)
    except (Py4JError, PySparkException) as e:
        if ";" in sql.strip().rstrip(";"):
            raise Denied("exactly one statement is allowed", Analysis("<not a single statement>", _hash(sql))) from e
        raise Denied("the statement could not be parsed", Analysis("<unparseable>", _hash(sql))) from None
    normalized = normal_form(sql)
    analysis = Analysis(normalized, _hash(normalized))
    nodes = list(plans.walk(plan))
    analysis.columns = sorted({_names(n.nameParts())[-1] for n, kind, _ in nodes if kind == "UnresolvedAttribute"})
    analysis.sensitive = sorted(set(analysis.columns) & set(sensitive))

    def deny(reason: str) -> Denied:
        return Denied(reason, analysis)

    if not 1 <= limit <= MOST_ROWS:
        raise deny(f"limit has to be between 1 and {MOST_ROWS}")
    ctes = _visible_ctes(plans, plan)
    for node, kind, parents in nodes:
        if kind not in (PLANS if plans.plan.isInstance(node) else EXPRESSIONS):
            raise deny(f"{kind.rstrip('$')} is not allowed")
        if kind == "UnresolvedFunction":
            name = ".".join(_names(node.nameParts())).lower()
            if name not in FUNCTIONS:
                raise deny(f"function {name} is not allowed")
        if kind == "UnresolvedStar" and (not parents or parents[-1] not in ("Project", "Aggregate") and not (parents[-1] == "UnresolvedFunction")):
            raise deny("* is only allowed as a projection or in count")
        if kind == "UnresolvedRelation":
            parts = _names(node.multipartIdentifier())
            if len(parts) != 1:
                raise deny("qualified table names are not allowed")
            if parts[0].lower() in ctes.get(node.hashCode(), ()):
                continue
            analysis.tables = sorted({*analysis.tables, parts[0]})
            if parts[0].lower() not in {t.lower() for t in tables}:
                raise deny(f"table {parts[0]} is not available to this role")
    if len(nodes) and nodes[0][1] == "UnresolvedRelation":
        raise deny("only SELECT is allowed")
    return analysis


def _visible_ctes(plans: _Plan, plan) -> dict[int, set[str]]:
    """For each relation, by its hash code, the names of the common tables that it can see."""
    out: dict[int, set[str]] = {}

    def visit(obj, seen: frozenset[str]) -> None:
        if not hasattr(obj, "getClass"):
            return
        if plans.node.isInstance(obj):
            kind = plans.name(obj)
            if kind == "UnresolvedRelation":
                out[obj.hashCode()] = out.get(obj.hashCode(), set(seen)) & seen
            elif kind == "UnresolvedWith":
                it, known = obj.cteRelations().iterator(), seen
                while it.hasNext():
                    pair = it.next()
                    visit(pair._2(), known)
                    known = known | {pair._1().lower()}
                visit(obj.child(), known)
                return
            for i in range(obj.productArity()):
                visit(obj.productElement(i), seen)
        elif plans.many.isInstance(obj):
            it = obj.iterator()
            while it.hasNext():
                visit(it.next(), seen)
        elif plans.product.isInstance(obj):
            for i in range(obj.productArity()):
                visit(obj.productElement(i), seen)

    visit(plan, frozenset())
    return out


def lineage(spark: SparkSession, df: DataFrame, tables: Mapping[str, Sequence[str]]) -> list[str]:
    """table.column of everything that the analyzed plan takes from the role's tables, by instance of a table."""
    plans, owners, used = _Plan(spark), {}, set()
    known = {t.lower(): t for t in tables}

    def visit(obj) -> None:
        if not hasattr(obj, "getClass"):
            return
        if plans.node.isInstance(obj):
            kind = plans.name(obj)
            if kind == "SubqueryAlias" and obj.alias().lower() in known and plans.name(obj.child()) == "View":
                for a in _names(obj.output()):
                    owners[a.exprId().id()] = f"{known[obj.alias().lower()]}.{a.name()}"
                return
            if kind == "AttributeReference":
                used.add(obj.exprId().id())
            for i in range(obj.productArity()):
                visit(obj.productElement(i))
        elif plans.many.isInstance(obj):
            it = obj.iterator()
            while it.hasNext():
                visit(it.next())
        elif plans.product.isInstance(obj) and plans.name(obj) in ("Some", "Tuple2", "Tuple3"):
            for i in range(obj.productArity()):
                visit(obj.productElement(i))

    plan = df._jdf.queryExecution().analyzed()
    visit(plan)
    used |= {a.exprId().id() for a in _names(plan.output())}
    return sorted({owners[i] for i in used if i in owners})


class DataLayer:
    """Tables under their names in a session of their own, and reads of them that are proven on the analyzed plan."""

    def __init__(self, spark: SparkSession, paths: Mapping[str, str]):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.plans = _Plan(self.spark)
        self.tables: dict[str, list[str]] = {}
        self.relations: list[tuple[object, set[str]]] = []
        for name, path in paths.items():
            df = self.spark.read.parquet(path)
            df.createOrReplaceTempView(name)
            self.tables[name] = df.columns
            self.relations.append((df._jdf.queryExecution().analyzed().relation(), set(df.columns)))
        registry, identifier = self.spark._jsparkSession.sessionState().functionRegistry(), self.spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        found = [registry.lookupFunction(identifier(name)) for name in FUNCTIONS]
        classes = {info.get().getClassName().rsplit(".", 1)[1] for info in found if info.isDefined()}
        # A builder makes expressions of its own name, or rounding ones.
        built = {c.removesuffix("ExpressionBuilder") for c in classes if c.endswith("ExpressionBuilder")}
        self.expressions = ANALYZED_EXPRESSIONS | classes | built | {f"Round{c}" for c in built & {"Ceil", "Floor"}}
        load = self.spark._jvm.java.lang.Class.forName
        self.command, self.replaceable, self.inherits, self.subquery = (load(f"org.apache.spark.sql.catalyst.{c}") for c in ("plans.logical.Command", "expressions.RuntimeReplaceable", "expressions.InheritAnalysisRules", "expressions.SubqueryExpression"))

    def read(self, sql: str) -> DataFrame:
        """The statement as a DataFrame; NotReadOnly, with nothing run or written, unless it only reads these tables."""
        state = self.spark._jsparkSession.sessionState()
        parsed = state.sqlParser().parsePlan(sql)
        if self.command.isInstance(parsed):
            raise NotReadOnly(f"{self.plans.name(parsed)} is a command")
        # Commands run as soon as a DataFrame is made of them, and some statements as soon as they are analyzed, so only
        # plans of known nodes are analyzed, and are looked at again before anything else.
        for node, kind, _ in self.plans.walk(parsed):
            if self.plans.plan.isInstance(node) and kind not in PLANS:
                raise NotReadOnly(f"{kind} is not allowed")
        analyzed = state.analyzer().execute(parsed)
        state.analyzer().checkAnalysis(analyzed)
        self._plan(analyzed)
        return self.spark.sql(sql)

    def _plan(self, plan) -> None:
        kind = self.plans.name(plan)
        if kind == "LogicalRelation":
            own = next((columns for relation, columns in self.relations if relation.equals(plan.relation())), None)
            if own is None or not {a.name() for a in _names(plan.output())} <= own:
                raise NotReadOnly("a relation or column that the role does not have")
        elif kind not in ANALYZED_PLANS:
            raise NotReadOnly(f"{kind} is not allowed")
        for e in _names(plan.expressions()):
            self._expression(e)
        for inner in (*_names(plan.children()), *(_names(plan.innerChildren()) if kind == "WithCTE" else ())):
            self._plan(inner)

    def _expression(self, e) -> None:
        kind = self.plans.name(e)
        if kind not in self.expressions:
            raise NotReadOnly(f"{kind.rstrip('$')} is not allowed")
        if self.subquery.isInstance(e):
            self._plan(e.plan())
        # What an allowed function is replaced by is the engine's own; its arguments are looked at.
        inherits = self.replaceable.isInstance(e) and self.inherits.isInstance(e)
        for child in _names(e.parameters() if inherits else e.children()):
            self._expression(child)


class Gateway:
    """One role and principal over a folder that holds the role's tables as Parquet, and nothing else."""

    def __init__(self, spark: SparkSession, role: str, principal: str, allowed: Mapping[str, Mapping], folder: str, audit: str):
        if role not in allowed:
            raise GatewayError(f"unknown role {role}")
        if not principal.strip():
            raise GatewayError("a principal is needed")
        self.role, self.principal, self.audit, self.owner = role, principal, audit, spark
        for name in allowed[role]:
            if not sources.files(spark, f"{folder}/{role}/{name}"):
                raise GatewayError(f"{role} has no data of {name}")
        self.data = DataLayer(spark, {name: f"{folder}/{role}/{name}" for name in allowed[role]})
        self.spark, self.tables = self.data.spark, self.data.tables
        # Sensitive names of every role: asking for one that this role lacks is recorded, too.
        self.sensitive = {c for tables in allowed.values() for own in tables.values() for c, p in own.get("pii", {}).items() if p == "sensitive"}

    def query(self, sql: str, limit: int = MOST_ROWS) -> Result:
        """The rows of one SELECT, limit at most; one audit event a call, written before a row is returned."""
        try:
            analysis = check(self.spark, sql, self.tables, self.sensitive, limit)
            try:
                df = self.data.read(sql)
                analysis.columns = lineage(self.spark, df, self.tables)
                analysis.sensitive = sorted({c.split(".")[1] for c in analysis.columns} & self.sensitive)
                rows = df.limit(limit).collect()
            except NotReadOnly as e:
                raise Denied(str(e), analysis) from None
            except Exception as e:  # noqa: BLE001  whatever the engine raises is an event
                condition = e.getCondition() if isinstance(e, PySparkException) else None
                raise Denied(f"{type(e).__name__}: {condition or 'failed'}", analysis) from None
        except Denied as e:
            self._write("query_denied", e.analysis, e.reason)
            raise
        self._write("query_executed", analysis, len(rows))
        return Result(df.columns, rows, analysis)

    def _write(self, kind: str, a: Analysis, last: str | int) -> None:
        now = datetime.datetime.now(datetime.UTC)
        event = (uuid.uuid4().hex, now, now, self.principal, self.role, a.sql_hash, a.normalized, a.tables, a.columns, a.sensitive, bool(a.sensitive), last)
        sources.append(self.owner.createDataFrame([event], AUDITED[kind]).coalesce(1), f"{self.audit}/{kind}")


def execute_readonly(spark: SparkSession, folder: str, sql: str, limit: int = MOST_ROWS) -> list[Row]:
    """The data layer alone, without the check of the statement, over all tables of a role's folder."""
    return DataLayer(spark, {path.rsplit("/", 1)[1]: path for path in sources.files(spark, f"{folder}/*")}).read(sql).limit(limit).collect()
