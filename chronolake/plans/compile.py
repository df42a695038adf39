"""From a parsed statement and a measurement to a DataFrame."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.errors import BadRequest
from chronolake.functions import time as times
from chronolake.operators import aggregates, filters
from chronolake.plans import sql
from chronolake.sources.measurement import Measurement, ident


@dataclass
class Options:
    """strict: refuse what the dialect's narrow form refuses. written_order: without ORDER BY, rows come latest write first.

    written: name of a column for the number of a row's write, next to rows that no aggregate has made.
    """

    strict: bool = False
    written_order: bool = False
    now_ns: Callable[[], int] = time.time_ns
    written: str | None = None


class Compiler:
    def __init__(self, m: Measurement, options: Options | None = None):
        self.m, self.options = m, options or Options()
        self._now: int | None = None

    def now(self) -> int:
        if self._now is None:
            self._now = self.options.now_ns()
        return self._now

    # Conditions.

    def condition(self, tree: Any) -> Column:
        if isinstance(tree, sql.Binary) and tree.op in ("AND", "OR"):
            left, right = self.condition(tree.left), self.condition(tree.right)
            return left & right if tree.op == "AND" else left | right
        if isinstance(tree, sql.Unary) and tree.op == "NOT":
            return ~self.condition(tree.arg)
        if isinstance(tree, sql.Binary) and tree.op in filters.OPS:
            return self._compare(tree.op, tree.left, tree.right)
        if isinstance(tree, sql.Between):
            both = self._compare(">=", tree.arg, tree.low) & self._compare("<=", tree.arg, tree.high)
            return ~both if tree.negated else both
        if isinstance(tree, sql.Among):
            one = reduce(lambda a, b: a | b, [self._compare("=", tree.arg, v) for v in tree.values])
            return ~one if tree.negated else one
        if isinstance(tree, sql.Like):
            if not isinstance(tree.arg, sql.Name) or not isinstance(tree.pattern, sql.Literal):
                raise BadRequest("unsupported SQL: LIKE")
            text = self._text(tree.arg.name)
            like = text.like(str(tree.pattern.value))
            return ~like if tree.negated else like
        if isinstance(tree, sql.IsNull):
            missing = isinstance(tree.arg, sql.Name) and tree.arg.name.lower() != "time" and not self.known(tree.arg.name)
            value = F.lit(None) if missing else self.value(tree.arg)
            return value.isNotNull() if tree.negated else value.isNull()
        if isinstance(tree, sql.Name):
            return self._compare("=", tree, sql.Literal(True))
        if isinstance(tree, sql.Literal) and isinstance(tree.value, bool):
            return F.lit(tree.value)
        raise BadRequest("unsupported SQL: condition expected")

    def _compare(self, op: str, left: Any, right: Any) -> Column:
        if isinstance(left, sql.Literal) and isinstance(right, sql.Literal) and not right.bare:
            raise BadRequest("unsupported SQL: a column is needed in a comparison")
        if isinstance(left, sql.Name):
            if left.name.lower() == "time" and left.name not in self.m.tags and left.name not in self.m.fields:
                return filters.time(self.m, op, self.time_value(right))
            if isinstance(right, sql.Literal):
                return filters.typed(self.m, left.name, op, right.value)
            return filters.native(op, self.value(left), self.value(right))
        if isinstance(left, sql.Call) and left.name == "DATE_BIN":
            return filters.native(op, self.bucket(left), F.lit(self.time_value(right)))
        return filters.native(op, self.value(left), self.value(right))

    def time_value(self, tree: Any) -> int | None:
        """Nanoseconds; None for what is no time."""
        if isinstance(tree, sql.Now):
            return self.now()
        if isinstance(tree, sql.Binary) and tree.op in "+-" and isinstance(tree.right, sql.Interval):
            base = self.time_value(tree.left)
            return None if base is None else base + (tree.right.ns if tree.op == "+" else -tree.right.ns)
        if isinstance(tree, sql.Literal):
            if isinstance(tree.value, datetime):
                return times.datetime_ns(tree.value)
            if isinstance(tree.value, int) and not isinstance(tree.value, bool):
                return tree.value
            if isinstance(tree.value, str):
                found = times.parse_iso(tree.value)
                if found is None and tree.value.lstrip("+-").isdigit():
                    found = int(tree.value)
                return found
        return None

    def bounds(self, tree: Any) -> tuple[float, float]:
        """Least and largest time that the conditions, joined by AND, leave."""
        low, high = -math.inf, math.inf
        if isinstance(tree, sql.Binary) and tree.op == "AND":
            (a, b), (c, d) = self.bounds(tree.left), self.bounds(tree.right)
            return max(a, c), min(b, d)
        name, value, op = None, None, None
        if isinstance(tree, sql.Binary) and tree.op in filters.OPS:
            name, value, op = tree.left, self.time_value(tree.right), tree.op
        if isinstance(tree, sql.Between) and not tree.negated:
            a = self.bounds(sql.Binary(">=", tree.arg, tree.low))
            b = self.bounds(sql.Binary("<=", tree.arg, tree.high))
            return a[0], b[1]
        if not isinstance(name, sql.Name) or name.name.lower() != "time" or self.known(name.name) or value is None:
            return low, high
        if op in (">", ">=", "="):
            low = value
        if op in ("<", "<=", "="):
            high = value
        return low, high

    def filtered(self, where: Any) -> DataFrame:
        df = self.m.df
        if where is None:
            return df
        if self.m.day:
            low, high = self.bounds(where)
            day = F.col(ident(self.m.day))
            if low > -math.inf:
                df = df.where(day >= F.date_from_unix_date(F.lit(int(low) // times.DAY)))
            if high < math.inf:
                df = df.where(day <= F.date_from_unix_date(F.lit(int(high) // times.DAY)))
        return df.where(self.condition(where))

    # Values.

    def known(self, name: str) -> bool:
        return name in self.m.tags or name in self.m.fields

    def _text(self, name: str) -> Column:
        if name in self.m.tags:
            return self.m.tag(name)
        own = self.m.of_class(name, "string") if name in self.m.fields else None
        return F.lit(None).cast("string") if own is None else own

    def tag_or_field(self, name: str) -> Column:
        return self.m.tag(name) if name in self.m.tags else self.m.field_value(name) if name in self.m.fields else F.lit(None)

    def field_or_tag(self, name: str) -> Column:
        """Field first, then tag, row by row where a name is both."""
        if name in self.m.fields and name in self.m.tags:
            return F.coalesce(self.m.field_value(name).cast("string"), self.m.tag(name))
        return self.m.field_value(name) if name in self.m.fields else self.m.tag(name) if name in self.m.tags else F.lit(None)

    def visible(self, name: str) -> Column:
        """As in a row of results: a tag hides a field of the same name where it has a value."""
        if name in self.m.fields and name in self.m.tags:
            return F.coalesce(self.m.tag(name), self.m.field_value(name).cast("string"))
        return self.tag_or_field(name)

    def bucket(self, call: sql.Call) -> Column:
        return times.bucket(self.m.time_ns, self.bucket_size(call))

    def bucket_size(self, call: sql.Call) -> int:
        if len(call.args) != 2:
            raise BadRequest("invalid DATE_BIN")
        size, column = call.args
        if isinstance(size, sql.Literal) and isinstance(size.value, str):
            size = sql.Interval(times.any_interval_ns(size.value))
        if not isinstance(size, sql.Interval) or not isinstance(column, sql.Name) or column.name.lower() != "time":
            raise BadRequest("invalid DATE_BIN")
        return size.ns

    def value(self, tree: Any) -> Column:
        if isinstance(tree, sql.Literal):
            return F.lit(tree.value)
        if isinstance(tree, sql.Name):
            if tree.name.lower() == "time" and not self.known(tree.name):
                return times.iso(self.m.time_ns)
            if not self.known(tree.name):
                raise BadRequest(f"unsupported column expression: {tree.name}")
            return self.visible(tree.name)
        if isinstance(tree, sql.Unary) and tree.op == "-":
            return -self.value(tree.arg)
        if isinstance(tree, sql.Binary) and tree.op in "+-*/%":
            a, b = self.value(tree.left), self.value(tree.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[tree.op]
        if isinstance(tree, sql.Call) and tree.name == "DATE_BIN":
            return times.iso(self.bucket(tree))
        if isinstance(tree, sql.Call) and tree.name.lower() in SCALARS:
            return F.call_function(tree.name.lower(), *[self.value(a) for a in tree.args])
        raise BadRequest("unsupported column expression")

    # Queries.

    def select(self, q: sql.Select) -> DataFrame:
        if q.distinct:
            return self._distinct(q)
        aggregated = any(aggregates.within(i.expr) for i in q.items)
        if aggregated or q.group:
            return self._aggregate(q)
        return self._rows(q)

    def all_columns(self) -> list[Column]:
        if "all" not in self.m.made:
            names = sorted({*self.m.tags, *self.m.fields} - {"time"})
            self.m.made["all"] = [self.visible(n).alias(n) for n in names] + [times.iso(self.m.time_ns).alias("time")]
        return self.m.made["all"]

    def _rows(self, q: sql.Select) -> DataFrame:
        if self.options.strict and q.items:
            raise BadRequest("unsupported SQL")
        df = self.filtered(q.where)
        order = []
        for by, down in q.order:
            if isinstance(by, sql.Name) and by.name.lower() == "time" and not self.known(by.name):
                col = self.m.df[ident(self.m.stamp)] if self.m.stamp else F.col("time_ns")
            elif self.options.strict:
                continue
            else:
                col = self.value(by)
            order.append(col.desc() if down else col.asc())
        if order or self.options.written_order:
            df = df.orderBy(*order, *self.m.written_order())
        df = self._cut(df, q)
        own = [F.col(ident(self.m.seq)).alias(self.options.written)] if self.options.written and self.m.seq else []
        if not q.items:
            return df.select(*self.all_columns(), *own)
        return df.select(*own, *[self.value(i.expr).alias(i.alias or label(i.expr)) for i in q.items])

    def _cut(self, df: DataFrame, q: sql.Select) -> DataFrame:
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None and not (self.options.strict and q.limit == 0):
            df = df.limit(q.limit)
        return df

    def _distinct(self, q: sql.Select) -> DataFrame:
        if not q.items:
            raise BadRequest("unsupported SQL: DISTINCT needs a column")
        names = []
        for i in q.items:
            if not isinstance(i.expr, sql.Name) or self.options.strict and len(q.items) > 1:
                raise BadRequest("unsupported SQL: DISTINCT takes a column")
            names.append((i.expr.name, i.alias or i.expr.name))
        df = self.filtered(q.where)
        cols = [self.field_or_tag(n).alias(a) for n, a in names if n.lower() != "time" or self.known(n)]
        if not cols:
            return self._cut(df.where("false").select(F.lit(None).cast("string").alias(names[0][1])), q)
        df = df.select(*cols)
        for c in df.columns:
            df = df.where(F.col(ident(c)).isNotNull())
        return self._cut(df.distinct().orderBy(*[F.col(ident(c)) for c in df.columns]), q)

    def _aggregate(self, q: sql.Select) -> DataFrame:
        bins = [g for g in q.group if isinstance(g, sql.Call) and g.name == "DATE_BIN"]
        aliases = {i.alias: i.expr for i in q.items if i.alias}
        keys: list[tuple[Any, Column]] = []
        for g in q.group:
            expr = aliases.get(g.name, g) if isinstance(g, sql.Name) and not self.known(g.name) else g
            if isinstance(expr, sql.Call) and expr.name == "DATE_BIN":
                keys.append((expr, self.bucket(expr)))
            elif isinstance(expr, sql.Name) and self.known(expr.name):
                keys.append((expr, self.visible(expr.name)))
            else:
                raise BadRequest("unsupported GROUP BY")
        binned = [k for k, _ in keys if isinstance(k, sql.Call)]
        if self.options.strict and (not binned or len(keys) > 1 or not bins):
            raise BadRequest("missing GROUP BY DATE_BIN")
        if len(binned) > 1:
            raise BadRequest("unsupported GROUP BY: one DATE_BIN")
        df = self.filtered(q.where)
        made, out, bin_name = [], [], None
        for k, item in enumerate(q.items):
            expr = item.expr
            if isinstance(expr, sql.Call) and expr.name == "DATE_BIN":
                if item.alias is None and self.options.strict:
                    raise BadRequest("invalid DATE_BIN: alias missing")
                if not binned:
                    raise BadRequest("missing GROUP BY DATE_BIN")
                if self.bucket_size(expr) != self.bucket_size(binned[0]):
                    raise BadRequest("DATE_BIN differs between SELECT and GROUP BY")
                bin_name = item.alias or "date_bin"
                at = next(n for n, (key, _) in enumerate(keys) if key is binned[0] or isinstance(key, sql.Call))
                out.append(times.iso(F.col(f"_k{at}")).alias(bin_name))
            elif aggregates.within(expr):
                if item.alias is None and self.options.strict:
                    raise BadRequest("invalid aggregate: alias missing")
                name = item.alias or label(expr)
                made.append(self._aggregated(expr).alias(f"_a{k}"))
                out.append(F.col(f"_a{k}").alias(name))
            else:
                at = next((n for n, (key, _) in enumerate(keys) if key == expr or isinstance(expr, sql.Name) and isinstance(key, sql.Name) and key.name == expr.name), None)
                if at is None:
                    raise BadRequest("unsupported column expression")
                out.append(F.col(f"_k{at}").alias(item.alias or label(expr)))
        if not keys and not made:
            raise BadRequest("unsupported SQL")
        grouped = df.groupBy(*[c.alias(f"_k{n}") for n, (_, c) in enumerate(keys)]).agg(*(made or [F.count(F.lit(1)).alias("_n")]))
        names = {i.alias or label(i.expr): k for k, i in enumerate(q.items)}
        order = []
        for by, down in q.order:
            col = None
            if isinstance(by, sql.Name) and by.name in names and names[by.name] is not None:
                item = q.items[names[by.name]]
                if aggregates.within(item.expr):
                    col = F.col(f"_a{names[by.name]}")
                else:
                    col = self._key_column(item.expr, keys)
            elif isinstance(by, sql.Name) and by.name.lower() == "time" and bin_name is not None or isinstance(by, sql.Call) and by.name == "DATE_BIN" and binned:
                col = self._key_column(binned[0], keys)
            elif isinstance(by, sql.Name):
                col = self._key_column(by, keys)
            if col is not None:
                order.append(col.desc() if down else col.asc())
        if order:
            grouped = grouped.orderBy(*order)
        return self._cut(grouped, q).select(*out)

    @staticmethod
    def _key_column(expr: Any, keys: list[tuple[Any, Column]]) -> Column | None:
        for n, (key, _) in enumerate(keys):
            if key == expr or isinstance(expr, sql.Call) and isinstance(key, sql.Call):
                return F.col(f"_k{n}")
        return None

    def _aggregated(self, expr: Any) -> Column:
        if isinstance(expr, sql.Call) and expr.name in sql.AGGREGATES:
            if expr.star:
                if expr.name != "COUNT" or self.options.strict:
                    raise BadRequest("invalid aggregate")
                return F.count(F.lit(1))
            if not expr.args or not isinstance(expr.args[0], sql.Name):
                raise BadRequest("invalid aggregate")
            order = expr.args[1] if len(expr.args) > 1 else sql.Name("time")
            if not isinstance(order, sql.Name):
                raise BadRequest("invalid aggregate")
            return aggregates.column(self.m, expr.name, expr.args[0].name, order.name, expr.distinct, self.field_or_tag)
        if isinstance(expr, sql.Binary) and expr.op in "+-*/%":
            a, b = self._aggregated(expr.left), self._aggregated(expr.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[expr.op]
        if isinstance(expr, sql.Literal):
            return F.lit(expr.value)
        raise BadRequest("unsupported column expression")


#: Spark functions that expressions over rows may use.
SCALARS = frozenset("abs ceil floor round sqrt ln exp pow upper lower length trim concat coalesce nullif greatest least substr".split())


def label(expr: Any) -> str:
    """Name of an item without an alias."""
    if isinstance(expr, sql.Name):
        return expr.name
    if isinstance(expr, sql.Call):
        return expr.name.lower()
    return "expr"
