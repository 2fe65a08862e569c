"""Guard of the SQL gateway: what a text may be, then what its parsed plan may be."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Statements by first word, those that need a limit, and aggregates that need none. Fixed values.
ALLOWED, LIMITED = r"\s*(SELECT|WITH|SHOW|DESCRIBE|EXPLAIN|PRAGMA)\b", r"\s*(SELECT|WITH)\b"
LIMIT_AT_END, AGGREGATE = r"\blimit\s+\d+\s*(?:offset\s+\d+\s*)?$", r"(count|sum|avg|min|max)\s*\([^()]*\)\s*(?:(?:as\s+)?[a-z_][a-z0-9_]*)?$"
_BLANKED = re.compile(r"""'(?:''|[^'])*(?:'|$)|"(?:""|[^"])*(?:"|$)|--[^\r\n]*|/\*.*?(?:\*/|$)""", re.DOTALL)
#: Logical plans that change nothing, by class name.
_READING = {"DescribeRelation", "DescribeColumn", "DescribeQueryCommand", "DescribeTableCommand", "DescribeColumnCommand", "DescribeFunction", "DescribeNamespace", "ExplainCommand"}


class GuardError(ValueError):
    """The statement isn't allowed."""


def blanked(sql: str) -> str:
    """Literals, quoted names and comments as spaces, everything else in its place."""
    return _BLANKED.sub(lambda m: " " * len(m.group()), sql)


def _bare(sql: str) -> str:
    return re.sub(r"(\s*;)+\s*$", "", blanked(sql).strip()).rstrip()


def _top_level(text: str) -> str:
    """What stands in parentheses as spaces."""
    depth, out = 0, []
    for c in text:
        depth = max(depth - (c == ")"), 0)
        out.append(c if depth == 0 and c not in "()" else " ")
        depth += c == "("
    return "".join(out)


def is_simple_aggregate(sql: str) -> bool:
    """A select of aggregates only, without groups or set operations."""
    text = blanked(sql)
    top = _top_level(text).lower()
    word = lambda w, at=0: re.compile(rf"\b{w}\b").search(top, at)
    group = word("group")
    if (group and word("by", group.end())) or any(map(word, ("union", "intersect", "except"))):
        return False
    select = word("select")
    source = word("from", select.end()) if select else None
    if not source:
        return False
    commas = [select.end() - 1, *(m.start() for m in re.finditer(",", top) if select.end() <= m.start() < source.start()), source.start()]
    return all(re.match(AGGREGATE, text[a + 1 : b].strip(), re.IGNORECASE) for a, b in zip(commas, commas[1:], strict=False))


def check_text(sql: str, allow_unlimited: bool = False) -> None:
    if not re.match(ALLOWED, sql, re.IGNORECASE):
        raise GuardError("this isn't a statement that reads: begin with SELECT, WITH, SHOW, DESCRIBE, EXPLAIN or PRAGMA")
    if ";" in _bare(sql):
        raise GuardError("more than one statement: give them one at a time")
    if not allow_unlimited and re.match(LIMITED, sql, re.IGNORECASE) and not (re.search(LIMIT_AT_END, _bare(sql), re.IGNORECASE) or is_simple_aggregate(sql)):
        raise GuardError("the result has no bound: end the statement with LIMIT n or LIMIT n OFFSET m, or allow an unlimited result")


#: Functions that run code of the JVM or read files beside the store.
FORBIDDEN = {"reflect", "try_reflect", "java_method", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files"}
_PLAN, _COMMAND = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", "org.apache.spark.sql.catalyst.plans.logical.Command"


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def check_plan(spark: SparkSession, sql: str, relations: Iterable[str] | None = None) -> None:
    """Reject any statement whose parsed plan holds, wherever it stands, a command, a forbidden function, or a relation that isn't
    among ``relations`` or the statement's own names: Spark has no read-only session, and reads files by path."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub(r"(\s*;)+\s*$", "", sql))
    except ParseException as e:
        raise GuardError(f"this can't be read as SQL: {e.getMessage() if hasattr(e, 'getMessage') else e}") from e
    is_a = lambda name, x: spark._jvm.java.lang.Class.forName(name).isInstance(x)
    waiting, read, own = [plan], [], set()
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if is_a(_PLAN, node):
            if name not in _READING and not name.startswith("Show") and (is_a(_COMMAND, node) or name.startswith(("Insert", "Create", "Replace", "Drop"))):
                raise GuardError(f"{name} isn't a statement that reads")
            if name == "UnresolvedRelation":
                read.append(_items(node.multipartIdentifier()))
            if name == "UnresolvedWith":
                own |= {pair._1().lower() for pair in _items(node.cteRelations())}
            waiting += _items(node.expressions().toList())
        if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            called = _items(node.nameParts() if name == "UnresolvedFunction" else node.name())[-1].lower()
            if called in FORBIDDEN:
                raise GuardError(f"the function {called} isn't allowed")
        for nodes in (node.children(), node.innerChildren()) if is_a(_PLAN, node) else (node.children(),):
            waiting += _items(nodes)
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            waiting.append(node.plan())
    if relations is not None:
        known = {r.lower() for r in relations} | own
        if bad := [".".join(parts) for parts in read if len(parts) > 1 or parts[0].lower() not in known]:
            raise GuardError(f"there is no table or view {bad[0]}")


def check(spark: SparkSession, sql: str, allow_unlimited: bool = False, relations: Iterable[str] | None = None) -> None:
    check_text(sql, allow_unlimited)
    if not re.match(r"\s*PRAGMA\b", sql, re.IGNORECASE):
        check_plan(spark, sql, relations)


def escape_like(term: str) -> str:
    """A term as a literal part of a LIKE pattern with ``\\`` as its escape."""
    return re.sub(r"([\\%_])", r"\\\1", term)
