"""Conditions on facts as SQL expressions.

A fact is a path into the struct column ``facts``. Its type decides how it compares, so a condition becomes one typed
expression that is never null and stays inside code generation. Expressions are built as text and read once by Spark:
a rule set has thousands of parts, and a Column call for each would take longer than the audit.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
ORDER = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "within_years": "<=", "older_than_years": ">", "before_year": "<", "after_year": ">"}
OPERATORS = ("exists", "equals", "contains", *ORDER)


def literal(value: Any) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, int):
        return str(value)
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{escaped}'"


def fact_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of the fact at a dotted path; None where there is none."""
    found: T.DataType | None = schema
    for name in path.split("."):
        found = found[name].dataType if isinstance(found, T.StructType) and name in found.names else None
    return found


def fact(schema: T.StructType, path: str, root: str = "facts") -> str:
    """The fact at a dotted path; null where there is none."""
    return "NULL" if fact_type(schema, path) is None else ".".join(f"`{x}`" for x in (root, *path.split(".")))


def truthy(text: str, kind: T.DataType | None) -> str:
    """Whether a value counts as present: not null, false, zero or empty."""
    if kind is None or isinstance(kind, T.NullType):
        return "false"
    if isinstance(kind, T.BooleanType):
        found = text
    elif isinstance(kind, NUMBERS):
        found = f"{text} <> 0"
    elif isinstance(kind, T.StringType):
        found = f"length({text}) > 0"
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        found = f"size({text}) > 0"
    else:
        found = f"{text} IS NOT NULL"
    return f"coalesce({found}, false)"


def as_number(text: str, kind: T.DataType) -> str:
    return f"double(int({text}))" if isinstance(kind, T.BooleanType) else f"double({text})"


def equal(text: str, kind: T.DataType | None, value: Any) -> str:
    """Equality in which null equals null, and true and one, false and zero are equal."""
    if value is None:
        return "true" if kind is None else f"({text} IS NULL)"
    if kind is None:
        return "false"
    if isinstance(value, (bool, int, float)):
        return f"({as_number(text, kind)} <=> {literal(float(value))})" if isinstance(kind, NUMBERS) else "false"
    if isinstance(value, str):
        return f"({text} <=> {literal(value)})" if isinstance(kind, T.StringType) else "false"
    if isinstance(value, (list, tuple)) and isinstance(kind, T.ArrayType):
        return f"({text} <=> cast(array({', '.join(map(literal, value))}) AS {kind.simpleString()}))"
    return "false"


def atom(schema: T.StructType, path: str, op: str = "exists", value: Any = None, negate: bool = False) -> str:
    """One condition on one fact (E2-E8); an unknown operator is an error when the plan is made."""
    kind, text = fact_type(schema, path), fact(schema, path)
    if op == "exists":
        found = truthy(text, kind)
    elif op == "equals":
        found = equal(text, kind, value)
    elif op == "contains":
        if isinstance(kind, T.StringType):
            found = f"coalesce(contains({text}, {literal(str(value))}), false)"
        elif isinstance(kind, T.ArrayType):
            found = f"coalesce(array_contains({text}, {literal(value)}), false)"
        else:
            found = "false"
    elif op in ORDER:
        numeric = isinstance(kind, NUMBERS) and isinstance(value, (bool, int, float))
        found = f"coalesce({as_number(text, kind)} {ORDER[op]} {literal(float(value))}, false)" if numeric else "false"
    else:
        raise ValueError(f"no operator {op!r}; there are {', '.join(OPERATORS)}")
    return f"(NOT {found})" if negate else found


def every(found: list[str]) -> str:
    return f"({' AND '.join(found)})" if found else "true"


def some(found: list[str]) -> str:
    return f"({' OR '.join(found)})" if found else "false"


def condition_text(schema: T.StructType, spec: Any) -> str:
    """A condition from its specification: a list of atoms (all must hold), or a mapping with ``all`` and ``any``."""

    def atoms(items: list[dict]) -> list[str]:
        return [atom(schema, i["fact"], i.get("op", "exists"), i.get("value"), bool(i.get("negate", False))) for i in items]

    if not spec:
        return "true"
    if isinstance(spec, list):
        return every(atoms(spec))
    return every([*([every(atoms(spec["all"]))] if spec.get("all") else []), *([some(atoms(spec["any"]))] if spec.get("any") else [])])


def condition(schema: T.StructType, spec: Any) -> Column:
    """``condition_text`` as a Column."""
    return F.expr(condition_text(schema, spec))


def shown(text: str, kind: T.DataType | None, form: str) -> str:
    """A fact as text, as a template's field shows it; null is a question mark."""
    if kind is None:
        return "'?'"
    if decimals := re.fullmatch(r"\.(\d+)f", form or ""):
        return f"if({text} IS NULL, '?', format_string('%.{decimals[1]}f', double({text})))"
    if isinstance(kind, T.ArrayType):
        quote = literal("'" if isinstance(kind.elementType, T.StringType) else "")
        return f"coalesce(concat('[', array_join(transform({text}, x -> concat({quote}, string(x), {quote})), ', '), ']'), '?')"
    plain = f"initcap(string({text}))" if isinstance(kind, T.BooleanType) else f"string({text})"
    return f"coalesce({plain}, '?')"


def template_text(schema: T.StructType, text: str) -> str:
    """A text with ``{path}`` and ``{path:.2f}`` fields filled from facts."""
    parts, at = [], 0
    for m in re.finditer(r"\{([A-Za-z_][\w.]*)(?::([^{}]*))?\}", text):
        parts += [literal(text[at : m.start()]), shown(fact(schema, m[1]), fact_type(schema, m[1]), m[2] or "")]
        at = m.end()
    return f"concat({', '.join([*parts, literal(text[at:])])})" if parts else literal(text)


def template(schema: T.StructType, text: str) -> Column:
    return F.expr(template_text(schema, text))
