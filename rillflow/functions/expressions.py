"""Typed expressions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SqlError
from ..plans.parser import Avg, Bin, Call, Col, Const, Neg
from .types import SIGNED, SPARK, UNSIGNED, convert, family

#: Gives a stream's column and its type.
Scope = Callable[[Col], tuple[Column, str]]


def compile_expression(e, scope: Scope) -> tuple[Column, str]:
    """Comparisons and AND are FALSE with NULL, never NULL; families of types don't mix."""
    if isinstance(e, Const):
        return F.lit(e.value).cast(SPARK[e.type]), e.type
    if isinstance(e, Col):
        return scope(e)
    if isinstance(e, Neg):
        c, t = compile_expression(e.of, scope)
        if t not in (*SIGNED, "FLOAT", "NULL"):
            raise SqlError(f"- of {t}")
        return -c, t
    if isinstance(e, Bin):
        (a, s), (b, t) = compile_expression(e.left, scope), compile_expression(e.right, scope)
        if e.op == "AND":
            if not {s, t} <= {"BOOLEAN", "NULL"}:
                raise SqlError(f"{s} AND {t}")
            return F.coalesce(a.cast("boolean"), F.lit(False)) & F.coalesce(b.cast("boolean"), F.lit(False)), "BOOLEAN"
        if "NULL" not in (s, t) and family(s) != family(t):
            raise SqlError(f"{s} {e.op} {t}")
        if e.op == "=":
            if {s, t} & {"BLOB", "DURATION"}:
                raise SqlError(f"{s} can't be compared")
            same = a == b
            if "FLOAT" in (s, t):
                same = same & ~F.isnan(a)
            return F.coalesce(same, F.lit(False)), "BOOLEAN"
        kind = family(s if t == "NULL" else t)
        if kind == "signed" or kind == "NULL":
            a, b, out = a.cast("bigint"), b.cast("bigint"), "BIGINT"
        elif kind == "unsigned":
            a, b, out = a.cast("decimal(20,0)"), b.cast("decimal(20,0)"), "UNSIGNED BIGINT"
        elif kind == "FLOAT":
            a, b, out = a.cast("float"), b.cast("float"), "FLOAT"
        else:
            raise SqlError(f"{s} {e.op} {t}")
        return (a + b if e.op == "+" else a * b).cast(SPARK[out]), out
    if isinstance(e, Call):
        args = [compile_expression(x, scope) for x in e.args]
        if e.name == "FLOOR_TIME":
            (ts, t), (d, u) = args
            if (t, u) != ("TIMESTAMP", "DURATION"):
                raise SqlError(f"FLOOR_TIME({t}, {u})")
            us = F.unix_micros(ts)
            return F.timestamp_micros(us - F.pmod(us, d)), "TIMESTAMP"
        ((c, t),) = args
        if t not in (*SIGNED, "FLOAT"):
            raise SqlError(f"{e.name}({t})")
        if e.name == "FLOOR":
            return (F.floor(c).cast("float") if t == "FLOAT" else c), t
        n = convert(c, t, "BIGINT")
        scale = 1_000_000 if e.name == "DURATION_SECS" else 1_000
        return F.when(n >= 0, n * scale).when(n.isNotNull(), F.raise_error(F.lit("a duration can't be negative")).cast("bigint")), "DURATION"
    if isinstance(e, Avg):
        raise SqlError("AVG stands in the select list only, by itself")
    raise SqlError(f"not an expression: {e}")


def equalities(e) -> list[tuple] | None:
    """The pairs that an ON condition of plain equalities compares; None for another one."""
    if isinstance(e, Bin) and e.op == "=":
        return None if isinstance(e.right, Bin) and e.right.op in ("AND", "=") else [(e.left, e.right)]
    if isinstance(e, Bin) and e.op == "AND":
        a, b = equalities(e.left), equalities(e.right)
        return None if a is None or b is None else a + b
    return None


def as_predicate(e, scope: Scope) -> Column:
    """For ON: plain equalities, which a join can hash or sort by; a NULL of theirs doesn't match either way."""
    pairs = equalities(e)
    c, t = compile_expression(e, scope)
    if t not in ("BOOLEAN", "NULL"):
        raise SqlError(f"ON needs a boolean, not {t}")
    if pairs is None:
        return F.coalesce(c.cast("boolean"), F.lit(False))
    out = None
    for a, b in pairs:
        (x, s), (y, _) = compile_expression(a, scope), compile_expression(b, scope)
        same = x == y
        if s == "FLOAT":
            same = same & ~F.isnan(x)
        out = same if out is None else out & same
    return out


__all__ = ["as_predicate", "compile_expression", "equalities", "SIGNED", "UNSIGNED"]
