"""Aggregates over a bucket's points."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolake.errors import BadRequest
from chronolake.plans import sql
from chronolake.sources.measurement import Measurement, ident


def within(tree: Any) -> bool:
    """Whether an aggregate stands in the expression."""
    if isinstance(tree, sql.Call):
        return tree.name in sql.AGGREGATES or any(map(within, tree.args))
    if isinstance(tree, sql.Binary):
        return within(tree.left) or within(tree.right)
    return isinstance(tree, sql.Unary) and within(tree.arg)


def ordering(m: Measurement, name: str, newest_last: bool) -> Column:
    """What FIRST and LAST order by: time, or a field or tag; without a value 0. Of ties, the latest write counts."""
    if name.lower() == "time" and name not in m.fields and name not in m.tags:
        parts = [F.col(ident(m.stamp)) if m.stamp else F.col("time_ns")]
    elif name in m.fields:
        kind = m.classes(name)
        if kind == ["number"]:
            number = m.of_class(name, "number")
            parts = [F.coalesce(number, F.lit(0).cast("double") if "f" in m.fields[name] else F.lit(0))]
        else:  # a missing value is the number 0, and numbers come first
            parts = []
            for c in kind:
                parts += [m.of_class(name, c).isNotNull(), m.of_class(name, c)] if c != "number" else []
            if "number" in kind:
                parts.append(F.coalesce(m.of_class(name, "number"), F.lit(0)))
    elif name in m.tags:
        parts = [m.tag(name).isNotNull(), m.tag(name)]
    else:
        parts = [F.lit(0)]
    if m.seq:
        seq = F.col(ident(m.seq))
        parts.append(seq if newest_last else -seq)
    return F.struct(*[p.alias(f"o{k}") for k, p in enumerate(parts)])


def column(m: Measurement, func: str, name: str, order: str, distinct: bool, field_or_tag: Callable[[str], Column]) -> Column:
    """One aggregate. AVG SUM COUNT MIN MAX read fields only; FIRST and LAST read fields, then tags."""
    if func in ("FIRST", "FIRST_VALUE"):
        return F.min_by(field_or_tag(name), ordering(m, order, False))
    if func in ("LAST", "LAST_VALUE"):
        return F.max_by(field_or_tag(name), ordering(m, order, True))
    if name not in m.fields:
        if name in m.tags and func == "COUNT" and distinct:
            return F.count_distinct(m.tag(name))
        return F.min(F.lit(None).cast("bigint"))
    value = m.field_value(name)
    if func == "COUNT":
        n = F.count_distinct(value) if distinct else F.count(value)
        return F.nullif(n, F.lit(0).cast("bigint"))
    if func in ("AVG", "SUM"):
        if m.classes(name) != ["number"]:
            raise BadRequest(f"{func} needs numbers: {name}")
        number = m.of_class(name, "number")
        if func == "AVG":
            return F.avg(number)
        kinds = m.fields[name]
        if "f" in kinds:
            return F.sum(number)
        total = F.sum(number.cast("decimal(38,0)"))
        # As a 64-bit integer where it fits; a decimal column only where larger values are stored already.
        return total if "d" in kinds else total.cast("bigint")
    pick = F.min if func == "MIN" else F.max
    own = [m.of_class(name, c) for c in m.classes(name)]
    if len(own) == 1:
        return pick(own[0])
    found = [pick(c).cast("variant") for c in (own if func == "MIN" else own[::-1])]
    return F.coalesce(*found)
