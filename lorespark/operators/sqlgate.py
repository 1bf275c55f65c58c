"""A policy gate for read-only SQL: default-deny over Catalyst's plan, bounded execution, redaction, audit records.

The statement is parsed, not run. Every node of its plan, every expression in it (those of subqueries, common tables and named
windows too), every function name, quoted or not, and every cast's type must be on an allow-list; tables must be in the
policy's set. The limit is injected or clamped, the result bounded in rows and bytes. Syntax of other dialects is a parse error,
which is a rejection too. Allowed names that Spark spells otherwise are rewritten after validation (array_length, json_build_object);
json_agg and its like are refused, since no Spark aggregate keeps nulls in order.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from lorespark.functions.text import sha256_text

# The function names that statements may use.
FUNCTIONS = frozenset("""
abs array_agg array_length avg bool_and bool_or btrim cast ceil ceiling char_length coalesce concat concat_ws count current_date
current_timestamp date_part date_trunc dense_rank every extract first_value floor greatest json_build_object
jsonb_build_object lag last_value lead least length localtimestamp lower ltrim max min mod now nth_value nullif
position power rank regexp_replace replace right round row_number rtrim split_part sqrt string_agg substring sum to_char to_date
to_timestamp trim upper
""".split())
PLANS = frozenset("Project Filter Aggregate Sort Join Union Distinct Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith With CTERelationDef UnresolvedSubqueryColumnAliases GlobalLimit LocalLimit UnresolvedInlineTable LateralJoin WithWindowDefinition UnresolvedHaving Window OneRowRelation LocalRelation".split())
EXPRESSIONS = frozenset("""
Add Alias And AttributeReference Cast Concat CurrentRow$ EqualNullSafe EqualTo GreaterThan GreaterThanOrEqual GroupingSets Cube Rollup ILike In
InSubquery IsNotNull IsNull LessThan LessThanOrEqual Like ListQuery Literal Multiply Not Or Remainder ScalarSubquery SortOrder SpecifiedWindowFrame
StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract UnaryMinus UnaryPositive UnboundedFollowing$
UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedFunction UnresolvedOrdinal UnresolvedStar UnresolvedWindowExpression
UnspecifiedFrame$ WindowExpression WindowSpecDefinition
""".split())
CONDITIONAL = {"Divide": "division", "CaseWhen": "case", "Exists": "exists"}
CAST_TYPES = re.compile(r"(bigint|boolean|binary|char|date|decimal|double|float|int|interval|smallint|string|time|timestamp|timestamp_ntz|varchar)\b")
LITERAL_FUNCTIONS = frozenset(("current_user", "session_user", "user", "current_role", "current_catalog", "current_database", "current_schema", "current_time", "grouping__id"))
EXTRAS = frozenset(("division", "case", "exists"))


class Rejected(ValueError):
    def __init__(self, category: str, message: str):
        super().__init__(message)
        self.category = category


@dataclass(frozen=True)
class Policy:
    tables: frozenset[str]
    max_rows: int = 1000
    max_bytes: int = 4_000_000
    max_cell_bytes: int = 1_000_000
    max_depth: int = 32
    max_items: int = 10_000
    max_characters: int = 100_000
    max_nodes: int = 4096
    extras: frozenset[str] = frozenset()  # of division, case, exists; each is refused unless named here


@dataclass
class Result:
    columns: list[str]
    rows: list[list]
    truncated: str | None = None
    limit: int | None = None
    limit_source: str = "injected"
    relations: list[str] = field(default_factory=list)


def _seq(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def _nodes(plan) -> list:
    """All plan nodes, those of subqueries and common table expressions included."""
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        found.append(p)
        todo += _seq(p.children()) + _seq(p.innerChildren())
    return found


def _expressions(node) -> list:
    """All expressions of a plan node, those of its named windows included."""
    found, todo = [], _seq(node.expressions())
    if node.nodeName() == "WithWindowDefinition":
        todo += _seq(node.windowDefinitions().values().toSeq())
    while todo:
        e = todo.pop()
        found.append(e)
        todo += _seq(e.children())
    return found


def _check_expression(e, policy: Policy) -> None:
    kind = e.getClass().getSimpleName()
    if kind in CONDITIONAL:
        if CONDITIONAL[kind] not in policy.extras:
            raise Rejected("operator", f"{CONDITIONAL[kind]} is not allowed")
    elif kind not in EXPRESSIONS:
        raise Rejected("operator", f"{kind} is not allowed")
    if kind == "UnresolvedFunction":
        parts = _seq(e.nameParts())
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS | {"between"}:
            raise Rejected("function", f"{'.'.join(parts)} is not allowed")
    elif kind == "UnresolvedAttribute":
        parts = _seq(e.nameParts())
        if len(parts) == 1 and parts[0].lower() in LITERAL_FUNCTIONS:
            raise Rejected("function", f"{parts[0]} is not allowed")
    elif kind == "Cast" and not CAST_TYPES.match(e.dataType().simpleString()):
        raise Rejected("operator", f"a cast to {e.dataType().simpleString()} is not allowed")


_FORBIDDEN = re.compile(r"(?is)\b(insert|update|delete|merge|create|drop|alter|truncate|grant|revoke|copy|into|for\s+update|for\s+share|recursive|tablesample|qualify|pivot|unpivot|offset|fetch|transform|lateral\s+view)\b")


def _stripped(sql: str) -> str:
    """Literals and quoted names emptied, comments left out, for the search of words."""
    part = r"(?s)('(?:[^']|'')*'|`[^`]*`|\"[^\"]*\")|--[^\n]*|/\*.*?\*/"
    return re.sub(part, lambda m: "''" if m[1] else " ", sql)


def validate(spark: SparkSession, sql: str, policy: Policy) -> tuple[str, list[str], int, str]:
    """(statement, relations, limit, limit source), or Rejected."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise Rejected("empty", "no statement")
    if len(text) > policy.max_characters:
        raise Rejected("too_long", "the statement is too long")
    bare = _stripped(text)
    if ";" in bare:
        raise Rejected("several_statements", "one statement only")
    if re.search(r"(?i)\blimit\s+all\b", bare):
        raise Rejected("limit", "the limit must be a number")
    if not re.match(r"(?is)\s*\(*\s*(select|with|values)\b", bare):
        raise Rejected("not_a_query", "only queries")
    if m := _FORBIDDEN.search(bare):
        raise Rejected("forbidden", f"{m[1]} is not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (ParseException, AnalysisException) as e:
        raise Rejected("syntax", str(e).splitlines()[0]) from e
    nodes = _nodes(plan)
    if len(nodes) > policy.max_nodes:
        raise Rejected("too_complex", "too many plan nodes")
    for n in nodes:
        if n.nodeName() not in PLANS:
            raise Rejected("plan_node", f"{n.nodeName()} is not allowed")
    expressions = [e for n in nodes for e in _expressions(n)]
    if len(nodes) + len(expressions) > policy.max_nodes:
        raise Rejected("too_complex", "too many expressions")
    for e in expressions:
        _check_expression(e, policy)
    names = [tuple(x.lower() for x in _seq(n.multipartIdentifier())) for n in nodes if n.nodeName() == "UnresolvedRelation"]
    own = {alias.lower() for n in nodes if n.nodeName() == "UnresolvedWith" for alias in (r._1() for r in _seq(n.cteRelations()))}
    relations = sorted({".".join(x) for x in names if x not in {(o,) for o in own}})
    for r in relations:
        if r not in policy.tables:
            raise Rejected("unknown_table", f"{r} is not in the policy")
    for o in own - policy.tables:  # a common table's name must not reach a table where it is out of scope
        if spark.catalog.tableExists(o):
            raise Rejected("unknown_table", f"{o} names a table that is not in the policy")
    tail = re.search(r"(?is)\blimit\s+(\S+)\s*$", bare)
    if len(re.findall(r"(?i)\blimit\b", bare)) > bool(tail):
        raise Rejected("nested_limit", "a limit may only end the statement")
    if tail and not tail[1].isdigit():
        raise Rejected("limit", "the limit must be a number")
    if not tail:
        return text, relations, policy.max_rows, "injected"
    asked = int(tail[1])
    return text, relations, min(asked, policy.max_rows), "explicit" if asked <= policy.max_rows else "clamped"


def _rewritten(sql: str) -> str:
    """Allowed names that Spark spells otherwise, outside of literals and quoted names: array_length(a, 1) is size(a),
    json_build_object(k, v, ...) is to_json(named_struct(k, v, ...))."""
    found = re.search(r"(?i)\b(array_length|jsonb?_build_object)\s*\(", _blanked(sql))
    if not found:
        return sql
    depth, end, commas, blank = 1, found.end(), [], _blanked(sql)
    while depth and end < len(sql):
        c = blank[end]
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 1:
            commas.append(end)
        end += 1
    inside = sql[found.end() : end - 1]
    if found[1].lower() == "array_length":
        new = f"size({sql[found.end() : commas[0] if commas else end - 1]})"
    else:
        new = f"to_json(named_struct({inside}))"
    return _rewritten(sql[: found.start()] + new + sql[end:])


def _blanked(sql: str) -> str:
    """The statement with the insides of literals, quoted names and comments as blanks, each sign in its place."""
    part = r"(?s)('(?:[^']|'')*'|`[^`]*`|\"[^\"]*\")|--[^\n]*|/\*.*?\*/"
    return re.sub(part, lambda m: " " * len(m[0]), sql)


def _over_views(sql: str, views: dict[str, str]) -> str:
    """The statement with the tables as common tables over views of other names, so that no view of the session is touched."""
    if not views:
        return sql
    heads = ", ".join(f"`{name}` AS (SELECT * FROM `{view}`)" for name, view in views.items())
    begun = re.match(r"(?is)(?:\s|--[^\n]*\n|/\*.*?\*/)*with\b", sql)
    return f"WITH {heads}, {sql[begun.end():]}" if begun else f"WITH {heads} {sql}"


def execute(spark: SparkSession, sql: str, policy: Policy, tables: dict[str, DataFrame], audit: Callable[[dict], None] = lambda record: None) -> Result:
    """Runs a valid statement over the policy's tables: at most max_rows rows and max_bytes of JSON, whole rows only.

    The tables are reached through views of random names, which are dropped afterwards; views of the session stay as they are.
    """
    base = {"sql": redacted(sql), "fingerprint": sha256_text(sql)}
    audit(base | {"state": "created"})
    try:
        text, relations, limit, source = validate(spark, sql, policy)
    except Rejected as e:
        audit(base | {"state": "rejected", "category": e.category})
        raise
    audit(base | {"state": "validated", "relations": relations, "limit": limit})
    began, views = time.monotonic(), {}
    try:
        for name in relations:
            views[name] = f"gated_{uuid.uuid4().hex}"
            tables[name].createTempView(views[name])
        df = spark.sql(_over_views(_rewritten(text), views))
        audit(base | {"state": "executing"})
        out = Result(df.columns, [], None, limit, source, relations)
        size = 2
        for row in df.limit(limit + 1).toLocalIterator(prefetchPartitions=False):
            if len(out.rows) == limit:
                out.truncated = "rows"
                break
            safe = [json_safe(v, policy) for v in row]
            more = len(json.dumps(safe, ensure_ascii=False, separators=(",", ":")).encode()) + bool(out.rows)
            if size + more > policy.max_bytes:
                out.truncated = "bytes"
                break
            size += more
            out.rows.append(safe)
    except Exception as e:
        category = {"TABLE_OR_VIEW_NOT_FOUND": "unknown_table", "UNRESOLVED_COLUMN": "unknown_column"}.get((e.getCondition() or "").split(".")[0], "analysis") if isinstance(e, AnalysisException) else "execution"
        audit(base | {"state": "failed", "category": category})
        if isinstance(e, AnalysisException):
            raise Rejected(category, str(e).splitlines()[0]) from e
        raise
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    audit(base | {"state": "succeeded", "rows": len(out.rows), "truncated": out.truncated, "seconds": time.monotonic() - began})
    return out


def json_safe(v, policy: Policy, depth: int = 0):
    """Decimals and dates as strings, rows and maps as objects; too deep, too many, too large or not finite: an error."""
    if depth > policy.max_depth:
        raise ValueError("a value is nested too deeply")
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, float):
        if not math.isfinite(v):
            raise ValueError("a value is not finite")
        return v
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (datetime.date, datetime.datetime, datetime.time)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        v = v.hex()
    if isinstance(v, str):
        if len(v.encode()) > policy.max_cell_bytes:
            raise ValueError("a value is too large")
        return v
    items = v.asDict() if hasattr(v, "asDict") else v
    if len(items) > policy.max_items:
        raise ValueError("a value has too many items")
    if isinstance(items, dict):
        return {str(k): json_safe(x, policy, depth + 1) for k, x in items.items()}
    return [json_safe(x, policy, depth + 1) for x in items]


def redacted(sql: str) -> str:
    """Literals hidden: strings, numbers and booleans."""
    try:
        out = re.sub(r"'(?:[^']|'')*'", "'<redacted>'", sql)
        parts = re.split(r"('<redacted>'|\"[^\"]*\"|`[^`]*`)", out)
        return "".join(p if i % 2 else re.sub(r"(?i)\b(true|false)\b", "false", re.sub(r"(?<![\w.])\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b", "0", p)) for i, p in enumerate(parts))
    except re.error:
        return "<not redactable>"


def schema_context(tables: dict[str, list[tuple[str, str]]], foreign_keys: list[tuple[str, str, str, str]] = (), budget: int = 24_000) -> tuple[str, list[str]]:
    """(text, omitted tables): whole tables as long as they fit, later ones may fit where one did not; then keys between those in it."""
    head = "Tables:\n"
    out, used, names, omitted = [head], len(head), set(), []
    for name in sorted(tables):
        block = f"{name}({', '.join(f'{c} {t}' for c, t in tables[name])})\n"
        if used + len(block) <= budget:
            out.append(block)
            used += len(block)
            names.add(name)
        else:
            omitted.append(name)
    for a, ca, b, cb in foreign_keys:
        line = f"{a}.{ca} -> {b}.{cb}\n"
        if a in names and b in names and used + len(line) <= budget:
            out.append(line)
            used += len(line)
    return "".join(out), omitted
