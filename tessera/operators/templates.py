"""Template documents: fields given, drawn or computed by small expressions, and their rules.

An expression is a subset of Python: arithmetic, comparisons, and/or/not, conditional expressions, names
of earlier fields, and calls of the functions below. It is compiled to a Spark column; nothing is evaluated.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import formats, hashing

DECIMAL = "decimal(28,6)"

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "pct": lambda x, p: x * p / F.lit(100).cast(DECIMAL),
    "round": lambda x, d=2: F.round(x, d if isinstance(d, int) else 2),
    "ceil_to": lambda x, step: (F.ceil(x / step) * step).cast(DECIMAL),
    "date_add": lambda d, n: F.date_add(d, n.cast("int")),
    "min": lambda *a: F.least(*a), "max": lambda *a: F.greatest(*a), "abs": lambda x: F.abs(x),
}


class TemplateError(ValueError):
    """An expression outside the subset."""


def compile_expression(text: str, fields: dict[str, Column], brackets: dict[str, list[tuple[float | None, float]]] | None = None) -> Column:
    """The column of an expression over ``fields``."""

    def visit(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant):
            if isinstance(n.value, bool) or isinstance(n.value, str):
                return F.lit(n.value)
            if isinstance(n.value, (int, float)):
                return F.lit(n.value).cast(DECIMAL)
        elif isinstance(n, ast.Name):
            if n.id not in fields:
                raise TemplateError(f"unknown field {n.id}")
            return fields[n.id]
        elif isinstance(n, ast.BinOp):
            a, b = visit(n.left), visit(n.right)
            if isinstance(n.op, ast.Add):
                return a + b
            if isinstance(n.op, ast.Sub):
                return a - b
            if isinstance(n.op, ast.Mult):
                return (a.cast(DECIMAL) * b.cast(DECIMAL)).cast(DECIMAL)
            if isinstance(n.op, ast.Div):
                return F.try_divide(a.cast(DECIMAL), b.cast(DECIMAL)).cast(DECIMAL)
        elif isinstance(n, ast.UnaryOp):
            if isinstance(n.op, ast.USub):
                return -visit(n.operand)
            if isinstance(n.op, ast.Not):
                return ~visit(n.operand)
        elif isinstance(n, ast.BoolOp):
            out = visit(n.values[0])
            for v in n.values[1:]:
                out = out & visit(v) if isinstance(n.op, ast.And) else out | visit(v)
            return out
        elif isinstance(n, ast.Compare):
            out, left = None, visit(n.left)
            for op, right in zip(n.ops, map(visit, n.comparators), strict=True):
                made = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}.get(type(op))
                if made is None:
                    raise TemplateError("unknown comparison")
                part = made(left, right)
                out, left = part if out is None else out & part, right
            return out
        elif isinstance(n, ast.IfExp):
            return F.when(visit(n.test), visit(n.body)).otherwise(visit(n.orelse))
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            if n.func.id == "bracket" and len(n.args) == 2 and isinstance(n.args[1], ast.Constant) and brackets and n.args[1].value in brackets:
                return formats.bracket_tax(visit(n.args[0]), brackets[n.args[1].value]).cast(DECIMAL)
            if n.func.id == "round" and len(n.args) == 2 and isinstance(n.args[1], ast.Constant):
                return F.round(visit(n.args[0]), int(n.args[1].value))
            if n.func.id in FUNCTIONS:
                return FUNCTIONS[n.func.id](*map(visit, n.args))
            raise TemplateError(f"unknown function {n.func.id}")
        raise TemplateError(f"{ast.dump(n)[:60]} is not allowed")

    try:
        return visit(ast.parse(text, mode="eval").body)
    except SyntaxError as why:
        raise TemplateError(f"cannot read {text!r}") from why


#: Built-in templates: fields in order; ``draw`` is (kind, low, high) or a list; ``rules`` must hold.
PAYSLIP = {
    "fields": [
        {"name": "salary", "draw": ("money", 1_500, 12_000)}, {"name": "hours", "draw": ("int", 0, 20)}, {"name": "department", "draw": ["engineering", "sales", "support"]},
        {"name": "overtime", "expr": "round(salary / 160 * 1.5 * hours, 2)"}, {"name": "gross", "expr": "salary + overtime"},
        {"name": "tax", "expr": "round(bracket(gross, 'income'), 2)"}, {"name": "pension", "expr": "round(pct(gross, 5), 2)"},
        {"name": "deductions", "expr": "tax + pension"}, {"name": "net", "expr": "gross - deductions"},
    ],
    "brackets": {"income": [(1_000.0, 0.0), (4_000.0, 0.2), (None, 0.4)]},
    "rules": {"net_positive": "net > 0", "adds_up": "net + tax + pension == gross"},
}


def build(ids: DataFrame, template: dict, seed: int = 0, id_col: str = "id") -> DataFrame:
    """One document per id. Unknown names, functions and loops of fields fail before anything runs."""
    df, fields = ids, {}
    for f in template["fields"]:
        if "draw" in f:
            d, key = f["draw"], F.col(id_col)
            if isinstance(d, list):
                value = hashing.pick(seed, f["name"], key, d)
            elif d[0] == "int":
                value = hashing.integer(seed, f["name"], key, d[1], d[2]).cast(DECIMAL)
            else:
                value = F.round((d[1] + hashing.uniform(seed, f["name"], key) * (d[2] - d[1])).cast(DECIMAL), 2)
        else:
            value = compile_expression(f["expr"], fields, template.get("brackets"))
        df = df.withColumn(f["name"], value if f.get("text") or isinstance(f.get("draw"), list) else value.cast(DECIMAL))
        fields[f["name"]] = F.col(f["name"])
    return df


def broken_rules(docs: DataFrame, template: dict, id_col: str = "id") -> DataFrame:
    """id, rule for every rule that a document breaks."""
    fields = {f["name"]: F.col(f["name"]) for f in template["fields"]}
    marks = F.filter(F.array(*[F.when(~F.coalesce(compile_expression(r, fields, template.get("brackets")), F.lit(False)), F.lit(n)) for n, r in template["rules"].items()]), lambda x: x.isNotNull())
    return docs.select(id_col, F.explode(marks).alias("rule"))
