"""Comparisons with the dialect's typing: values of unlike classes never convert, they compare by class.

Numbers come before booleans, booleans before strings. What the classes decide is a constant in the plan, so that Spark's own
conversions never apply and the rest of the comparison can reach the scan.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolake.sources.measurement import CLASS_ORDER, Measurement, ident

OPS = frozenset({"=", "!=", ">", "<", ">=", "<="})


def native(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def class_of(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"


def _number(value: float) -> Column:
    """Never a decimal literal, which would change the comparison's type."""
    return F.lit(value).cast("double") if isinstance(value, float) else F.lit(value)


def _across(op: str, own: Column, own_class: str, other: str) -> Column:
    lower = CLASS_ORDER.index(own_class) < CLASS_ORDER.index(other)
    true = op == "!=" or op in ("<", "<=") and lower or op in (">", ">=") and not lower
    return own.isNotNull() if true else F.lit(False)


def typed(m: Measurement, name: str, op: str, value: Any) -> Column:
    """A tag, or else a field, against a literal. A missing value is never true."""
    if value is None:
        return F.lit(False)
    wanted = class_of(value)
    lit = _number(value) if wanted == "number" else F.lit(value)

    def against(col: Column, own_class: str) -> Column:
        return native(op, col, lit) if own_class == wanted else _across(op, col, own_class, wanted)

    parts = []
    if name in m.tags:
        parts.append(against(m.tag(name), "string"))
    if name in m.fields:
        own = [against(m.of_class(name, c), c) for c in m.classes(name)]
        both = reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), own)
        parts.append(both & m.tag(name).isNull() if name in m.tags else both)
    if not parts:
        return F.lit(False)
    return parts[0] if len(parts) == 1 else F.coalesce(parts[0], F.lit(False)) | F.coalesce(parts[1], F.lit(False))


def time(m: Measurement, op: str, ns: int | None) -> Column:
    """Time against nanoseconds, on the column that the files hold, so that the comparison reaches the scan.

    Against what is no time, only <, <= and != are true: a number comes before anything else.
    """
    if ns is None:
        return F.lit(op in ("<", "<=", "!="))
    if not m.stamp:
        return native(op, F.col("time_ns"), F.lit(ns))
    col = F.col(ident(m.stamp))
    kind = dict(m.df.dtypes)[m.stamp]
    micros, rest = divmod(ns, 1000)
    if rest and op in ("=", "!="):
        return F.lit(op == "!=") & col.isNotNull()
    if rest:  # between two microseconds: below it up to the lower one, above it from the next
        op = {"<": "<=", ">=": ">"}.get(op, op)
    return native(op, col, F.timestamp_micros(F.lit(micros)).cast(kind))
