"""Whether a text is one read-only query, as Spark's own parser and analyser see it."""

from __future__ import annotations

import re

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Functions that call any static Java method by name.
_CALLS_JAVA = re.compile(r"\b(try_reflect|reflect|java_method)\b", re.IGNORECASE)
_STARTS = re.compile(r"[\s(]*(select|with|values)\b", re.IGNORECASE)


class ToolError(ValueError):
    """A request that cannot be carried out; its text is meant for whoever asked."""


def _nodes(plan):
    """A plan's nodes, with those of common table expressions and of subqueries in expressions."""
    yield plan
    for found in (plan.children(), plan.subqueries()):
        for i in range(found.size()):
            yield from _nodes(found.apply(i))


def cleaned(sql: str) -> str:
    """Without outer white space and a last semicolon."""
    return (sql or "").strip().removesuffix(";").strip()


def checked(spark: SparkSession, sql: str) -> str:
    """``sql`` if it is one query that changes nothing and calls nothing outside; else ToolError.

    The check is made on the parsed plan, before anything could run: no command and no statement may
    be in it. Calls into Java by name are refused wherever their names stand, even in a literal.
    """
    text = cleaned(sql)
    if not text:
        raise ToolError("there is no SQL")
    if not _STARTS.match(text):
        raise ToolError("only queries (SELECT, WITH, VALUES) are allowed")
    if _CALLS_JAVA.search(text):
        raise ToolError("functions that call Java are not allowed")
    gateway = spark.sparkContext._gateway
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise ToolError(f"not one query: {_first_line(e)}") from e
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if "Script" in name or any(is_instance_of(gateway, node, _LOGICAL + kind) for kind in ("Command", "ParsedStatement")):
            raise ToolError(f"{name} is not allowed: access is read-only")
    return text


def query(spark: SparkSession, sql: str) -> DataFrame:
    """The checked query, analysed. ``spark`` should not run SQL on files (see ``Analysis``)."""
    text = checked(spark, sql)
    try:
        df = spark.sql(text)
    except (AnalysisException, ParseException) as e:
        raise ToolError(_first_line(e)) from e
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        if "Script" in node.getClass().getSimpleName():
            raise ToolError("running programs is not allowed")
    return df


def condition(spark: SparkSession, where: str | None) -> str | None:
    """A condition alone, without the word WHERE; None for an empty one. It may not end the clause that it is in."""
    text = cleaned(where or "")
    text = re.sub(r"^where\b", "", text, flags=re.IGNORECASE).strip()
    if not text:
        return None
    try:
        spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as e:
        raise ToolError(f"not a condition: {_first_line(e)}") from e
    checked(spark, f"SELECT 1 WHERE {text}")
    return text


def _first_line(e: Exception) -> str:
    text = str(getattr(e, "java_exception", None) and e.java_exception.getMessage() or e)
    return next((x for x in text.splitlines() if x.strip()), type(e).__name__)
