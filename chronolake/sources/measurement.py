"""A measurement as the query compiler sees it: a DataFrame, its time, and its tags and fields by kind."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.functions import time as times

#: Kinds of field values: integers of 64 bits, larger integers, floats, booleans and strings.
KINDS = "idfbs"
CLASSES = {"i": "number", "d": "number", "f": "number", "b": "boolean", "s": "string"}
#: Values of different classes compare by the order of the classes.
CLASS_ORDER = ["number", "boolean", "string"]


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Measurement:
    """columns of df: tags[name] is the column of a tag, fields[name][kind] that of a field's values of one kind.

    stamp names a timestamp column where the measurement is a view of a table; without it there is a column time_ns.
    seq names the column that tells the order of writing; the later write has the larger number.
    """

    name: str
    df: DataFrame
    tags: dict[str, str]
    fields: dict[str, dict[str, str]]
    seq: str | None = "_seq"
    stamp: str | None = None
    day: str | None = None
    #: What a compiler has made of the columns, for the queries that follow.
    made: dict[str, Any] = field(default_factory=dict)

    @property
    def time_ns(self) -> Column:
        return times.ns_of(F.col(self.stamp)) if self.stamp else F.col("time_ns")

    def of_class(self, name: str, wanted: str) -> Column | None:
        """A field's values of one class; integers and floats together are floats."""
        kinds = self.fields[name]
        if wanted != "number":
            return F.col(ident(kinds[wanted[0]])) if wanted[0] in kinds else None
        own = [k for k in "idf" if k in kinds]
        if not own:
            return None
        if len(own) == 1:
            return F.col(ident(kinds[own[0]]))
        as_type = "double" if "f" in own else "decimal(38,0)"
        return F.coalesce(*[F.col(ident(kinds[k])).cast(as_type) for k in own])

    def classes(self, name: str) -> list[str]:
        return [c for c in CLASS_ORDER if any(CLASSES[k] == c for k in self.fields[name])]

    def field_value(self, name: str) -> Column:
        """A field's value as it is: of its one type, or a variant if types are mixed."""
        kinds = self.fields[name]
        own = [F.col(ident(kinds[k])) for k in KINDS if k in kinds]
        return own[0] if len(own) == 1 else F.coalesce(*[c.cast("variant") for c in own])

    def tag(self, name: str) -> Column:
        return F.col(ident(self.tags[name]))

    def written_order(self) -> list[Column]:
        """Latest write first."""
        return [F.col(ident(self.seq)).desc()] if self.seq else []

    def latest(self) -> Measurement:
        """Of points with the same tags and time only the one written last, with all its fields."""
        series = [F.col(ident(c)) for c in self.tags.values()]
        stamp = self.stamp or "time_ns"
        days = [F.col(ident(self.day))] if self.day else []
        newest = self.df.groupBy(*days, *series, F.col(ident(stamp))).agg(F.max_by(F.struct(*[F.col(ident(c)) for c in self.df.columns]), F.col(ident(self.seq))).alias("newest"))
        return replace(self, df=newest.select("newest.*"), made={})


def view(name: str, df: DataFrame, stamp: str, tags: list[str], fields: list[str], seq: str | None) -> Measurement:
    """A table with a timestamp column as a measurement."""
    kinds = {"bigint": "i", "int": "i", "double": "f", "float": "f", "boolean": "b", "string": "s"}
    types = dict(df.dtypes)
    return Measurement(name, df, {t: t for t in tags}, {f: {kinds[types[f]]: f} for f in fields}, seq, stamp)
