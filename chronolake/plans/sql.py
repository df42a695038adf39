"""The SQL dialect: a tokenizer and a parser to a small tree. Nothing is looked up here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from chronolake.errors import BadRequest
from chronolake.functions import time as times


@dataclass(frozen=True)
class Literal:
    value: Any  # int, float, bool, str or None
    bare: bool = False  # a word without quotes on the value's side of a comparison


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Interval:
    ns: int


@dataclass(frozen=True)
class Now:
    pass


@dataclass(frozen=True)
class Call:
    name: str  # upper case
    args: tuple
    star: bool = False
    distinct: bool = False


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Unary:
    op: str
    arg: Any


@dataclass(frozen=True)
class Among:
    arg: Any
    values: tuple
    negated: bool


@dataclass(frozen=True)
class Between:
    arg: Any
    low: Any
    high: Any
    negated: bool


@dataclass(frozen=True)
class Like:
    arg: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class IsNull:
    arg: Any
    negated: bool


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None


@dataclass
class Select:
    measurement: str
    items: list[Item]  # empty: all columns
    distinct: bool = False
    where: Any = None
    group: list = field(default_factory=list)
    order: list[tuple[Any, bool]] = field(default_factory=list)  # expression, descending
    limit: int | None = None
    offset: int = 0


@dataclass
class Delete:
    measurement: str
    where: Any


@dataclass
class Insert:
    measurement: str
    select: Select


@dataclass
class Other:
    """A statement that changes nothing."""

    text: str


AGGREGATES = frozenset({"AVG", "SUM", "COUNT", "MIN", "MAX", "FIRST", "LAST", "FIRST_VALUE", "LAST_VALUE"})
_TOKEN = re.compile(
    r"""\s+|--[^\n]*|
    (?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<param>\$[A-Za-z_]\w*)|
    (?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|
    (?P<word>(?:[^\W\d]|\\.)(?:\w|\\.)*)|
    (?P<op><>|!=|>=|<=|[=<>+\-*/%(),;.])""",
    re.VERBOSE | re.DOTALL,
)
RESERVED = frozenset("SELECT FROM WHERE GROUP ORDER BY LIMIT OFFSET AND OR NOT IN BETWEEN LIKE IS NULL AS ASC DESC DISTINCT INTERVAL".split())


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    value: Any = None

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.upper() in words


def tokens(text: str, params: dict[str, Any]) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise BadRequest(f"unsupported SQL near {text[at : at + 20]!r}")
        at, kind, own = found.end(), found.lastgroup, found.group()
        if kind is None:
            continue
        if kind == "string":
            out.append(Token("literal", own, own[1:-1].replace("''", "'")))
        elif kind == "param":
            if own[1:] not in params:
                raise BadRequest(f"missing parameter: {own}")
            out.append(Token("literal", own, params[own[1:]]))
        elif kind == "number":
            out.append(Token("literal", own, int(own) if own.isdigit() else float(own)))
        elif kind == "quoted":
            out.append(Token("quoted", own, own[1:-1].replace('""', '"')))
        elif kind == "word":
            out.append(Token("word", re.sub(r"\\(.)", r"\1", own)))
        else:
            out.append(Token("op", own))
    return [*out, Token("end", "")]


class Parser:
    def __init__(self, text: str, params: dict[str, Any] | None = None):
        own = {str(k).removeprefix("$"): v for k, v in (params or {}).items()}
        self.all, self.at = tokens(text, own), 0

    # Moving.

    @property
    def now(self) -> Token:
        return self.all[self.at]

    def next(self) -> Token:
        self.at += 1
        return self.all[self.at - 1]

    def word(self, *words: str) -> bool:
        """Takes the words if they come next."""
        for k, w in enumerate(words):
            if not self.all[min(self.at + k, len(self.all) - 1)].is_word(w):
                return False
        self.at += len(words)
        return True

    def op(self, *ops: str) -> str | None:
        if self.now.kind == "op" and self.now.text in ops:
            return self.next().text
        return None

    def need(self, op: str) -> None:
        if not self.op(op):
            raise BadRequest(f"unsupported SQL: {op} expected near {self.now.text!r}")

    def name(self) -> str:
        token = self.next()
        if token.kind == "quoted":
            return token.value
        if token.kind != "word":
            raise BadRequest(f"unsupported SQL: name expected near {token.text!r}")
        return token.text

    def end(self) -> None:
        while self.op(";"):
            pass
        if self.now.kind != "end":
            raise BadRequest(f"unsupported SQL near {self.now.text!r}")

    # Statements.

    def statement(self) -> Select | Delete | Insert | Other:
        if self.now.is_word("SELECT"):
            out: Any = self.select()
        elif self.word("DELETE", "FROM"):
            out = Delete(self.name(), self.expression() if self.word("WHERE") else None)
        elif self.word("INSERT", "INTO"):
            out = Insert(self.name(), self.select())
        else:
            return Other(" ".join(t.text for t in self.all))
        self.end()
        return out

    def select(self) -> Select:
        if not self.word("SELECT"):
            raise BadRequest("unsupported SQL: SELECT expected")
        distinct = self.word("DISTINCT")
        items: list[Item] = []
        if not self.op("*"):
            items.append(self.item())
            while self.op(","):
                items.append(self.item())
        if not self.word("FROM"):
            raise BadRequest(f"unsupported SQL: FROM expected near {self.now.text!r}")
        out = Select(self.name(), items, distinct)
        if self.word("WHERE"):
            out.where = self.expression()
        if self.word("GROUP", "BY"):
            out.group = [self.expression()]
            while self.op(","):
                out.group.append(self.expression())
        if self.word("ORDER", "BY"):
            while True:
                by = self.expression()
                down = self.word("DESC")
                if not down:
                    self.word("ASC")
                out.order.append((by, down))
                if not self.op(","):
                    break
        while self.now.is_word("LIMIT", "OFFSET"):
            what = self.next().text.upper()
            count = self.next()
            if count.kind != "literal" or isinstance(count.value, bool) or not isinstance(count.value, int):
                raise BadRequest(f"invalid {what}")
            if what == "LIMIT":
                out.limit = count.value
            else:
                out.offset = count.value
        return out

    def item(self) -> Item:
        expr = self.expression()
        if self.word("AS"):
            return Item(expr, self.name())
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.text.upper() not in RESERVED:
            return Item(expr, self.name())
        return Item(expr, None)

    # Expressions, loosest first.

    def expression(self) -> Any:
        left = self._and()
        while self.word("OR"):
            left = Binary("OR", left, self._and())
        return left

    def _and(self) -> Any:
        left = self._not()
        while self.word("AND"):
            left = Binary("AND", left, self._not())
        return left

    def _not(self) -> Any:
        return Unary("NOT", self._not()) if self.word("NOT") else self._comparison()

    def _comparison(self) -> Any:
        left = self._sum()
        if op := self.op("=", "!=", "<>", ">=", "<=", ">", "<"):
            return Binary("!=" if op == "<>" else op, left, self._value())
        negated = self.now.is_word("NOT") and self.all[self.at + 1].is_word("IN", "BETWEEN", "LIKE")
        if negated:
            self.next()
        if self.word("IN"):
            self.need("(")
            values = [self._value()]
            while self.op(","):
                values.append(self._value())
            self.need(")")
            return Among(left, tuple(values), negated)
        if self.word("BETWEEN"):
            low = self._value()
            if not self.word("AND"):
                raise BadRequest("unsupported SQL: AND expected in BETWEEN")
            return Between(left, low, self._value(), negated)
        if self.word("LIKE"):
            return Like(left, self._value(), negated)
        if self.word("IS"):
            negated = self.word("NOT")
            if not self.word("NULL"):
                raise BadRequest("unsupported SQL: NULL expected")
            return IsNull(left, negated)
        return left

    def _value(self) -> Any:
        """The value's side of a comparison: double quotes and bare words are strings there."""
        out = self._sum(value=True)
        return Literal(out.name, True) if isinstance(out, Name) else out

    def _sum(self, value: bool = False) -> Any:
        left = self._product(value)
        while op := self.op("+", "-"):
            left = Binary(op, left, self._product(value))
        return left

    def _product(self, value: bool) -> Any:
        left = self._sign(value)
        while op := self.op("*", "/", "%"):
            left = Binary(op, left, self._sign(value))
        return left

    def _sign(self, value: bool) -> Any:
        if self.op("-"):
            arg = self._sign(value)
            return Literal(-arg.value) if isinstance(arg, Literal) and isinstance(arg.value, int | float) else Unary("-", arg)
        self.op("+")
        return self._atom(value)

    def _atom(self, value: bool) -> Any:
        if self.op("("):
            out = self.expression()
            self.need(")")
            return out
        token = self.next()
        if token.kind == "literal":
            return Literal(token.value)
        if token.kind == "quoted":
            return Literal(token.value) if value else Name(token.value)
        if token.kind != "word":
            raise BadRequest(f"unsupported SQL near {token.text!r}")
        word = token.text.upper()
        if word in ("TRUE", "FALSE"):
            return Literal(word == "TRUE")
        if word == "NULL":
            return Literal(None)
        if word == "INTERVAL":
            text = self.next()
            if text.kind != "literal" or not isinstance(text.value, str):
                raise BadRequest(f"invalid interval: {text.text}")
            return Interval(times.interval_ns(text.value))
        if self.op("("):
            return self._call(word)
        return Name(token.text)

    def _call(self, word: str) -> Any:
        if word == "NOW":
            self.need(")")
            return Now()
        if self.op("*"):
            self.need(")")
            return Call(word, (), star=True)
        distinct = self.word("DISTINCT")
        args = []
        if not self.op(")"):
            args.append(self._argument(word))
            while self.op(","):
                args.append(self._argument(word))
            self.need(")")
        return Call(word, tuple(args), distinct=distinct)

    def _argument(self, word: str) -> Any:
        out = self.expression()
        if word in ("FIRST_VALUE", "LAST_VALUE") and self.word("ORDER", "BY"):
            self.expression()  # FIRST_VALUE(x ORDER BY time): time is the order in any case
            self.word("ASC")
        return out


def parse(text: str, params: dict[str, Any] | None = None) -> Select | Delete | Insert | Other:
    return Parser(text, params).statement()
