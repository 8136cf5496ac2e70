"""A small sandboxed template language for conversations.

parse() makes a syntax tree, folded() computes what is constant, and compiled() turns the
tree into Python closures that yield (text, trained) pieces: trained is true inside
{% generation %} ... {% endgeneration %}. Messages may come as a stream: a loop looks one
item ahead and no further, so that a conversation of any length needs memory for two
messages only.

There are blocks for, if/elif/else, set and generation; expressions with or, and, not,
comparisons, in, +, ~, [...], .name, literals, lists and the filters given to the
compiler. A name reaches only what the caller passes, an attribute only a key of a
dict, and nothing can be called, so a template cannot get at anything else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template, or what it asks for, is wrong."""


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    #: (condition, body) in turn; the condition of else is Const(True)
    arms: tuple


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---------------------------------------------------------------- parser

_PARTS = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.,()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"and", "or", "not", "in", "is"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "str":
            value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), value[1:-1], flags=re.S)
        elif kind == "num":
            value = int(value)
        out.append((kind, value))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing over the tokens of one expression."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "~"))

    def __init__(self, tokens: list[tuple[str, Any]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> Any:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, value: Any = None) -> Any:
        kind, got = self.peek()
        if kind is None or (value is not None and (kind == "str" or got != value)):
            raise TemplateError(f"expected {value!r}, got {got!r}")
        self.at += 1
        return got

    def is_op(self, *ops: str) -> bool:
        kind, value = self.peek()
        return kind in ("op", "name") and value in ops

    def level(self, k: int = 0) -> Any:
        if k == len(self.LEVELS):
            return self.unary()
        if k == 2 and self.is_op("not"):
            self.take()
            return Unary("not", self.level(2))
        left = self.level(k + 1)
        while self.is_op(*self.LEVELS[k]) or (k == 2 and self.is_op("not")):
            op = self.take()
            if op == "not":
                self.take("in")
                left = Unary("not", Binary("in", left, self.level(k + 1)))
            else:
                left = Binary(op, left, self.level(k + 1))
        return left

    def unary(self) -> Any:
        out = self.atom()
        while self.is_op(".", "[", "|"):
            op = self.take()
            if op == ".":
                out = Item(out, Const(self.take()))
            elif op == "[":
                out = Item(out, self.level())
                self.take("]")
            else:
                out = Filter(self.take(), out)
        return out

    def atom(self) -> Any:
        kind, value = self.peek()
        if kind in ("str", "num"):
            self.at += 1
            return Const(value)
        if kind == "name" and value not in _KEYWORDS:
            self.at += 1
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        if value in ("(", "["):
            self.at += 1
            close, items = {"(": ")", "[": "]"}[value], []
            while not self.is_op(close):
                items.append(self.level())
                if not self.is_op(close):
                    self.take(",")
            self.take(close)
            return items[0] if value == "(" and len(items) == 1 else ListOf(tuple(items))
        raise TemplateError(f"unexpected {value!r}")


def _expression(tokens: list[tuple[str, Any]]) -> Any:
    e = _Expression(tokens)
    out = e.level()
    if e.at < len(tokens):
        raise TemplateError(f"unexpected {tokens[e.at][1]!r}")
    return out


def parse(source: str) -> tuple:
    """The syntax tree of a template; {{- and -}} strip white space as usual."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at, strip_next = 0, False

    def text(part: str, strip_end: bool) -> None:
        part = part.lstrip() if strip_next else part
        part = part.rstrip() if strip_end else part
        if part:
            stack[-1][2].append(Output(Const(part)))

    def close(kind: str) -> tuple[Any, tuple]:
        if stack[-1][0] != kind or len(stack) == 1:
            raise TemplateError(f"end of {kind} without its start")
        _, head, body = stack.pop()
        return head, tuple(body)

    for m in _PARTS.finditer(source):
        text(source[at : m.start()], source.startswith("-", m.start() + 2))
        at, strip_next = m.end(), source[m.end() - 3] == "-"
        if m[1] is not None:
            stack[-1][2].append(Output(_expression(_tokens(m[1]))))
        elif m[2] is not None:
            tokens = _tokens(m[2])
            word, rest = tokens[0][1] if tokens else "", tokens[1:]
            if word == "for":
                if len(rest) < 3 or rest[1] != ("name", "in"):
                    raise TemplateError(f"for NAME in LIST: {m[2]!r}")
                stack.append(("for", (rest[0][1], _expression(rest[2:])), []))
            elif word == "endfor":
                (name, over), body = close("for")
                stack[-1][2].append(For(name, over, body))
            elif word == "if":
                stack.append(("if", [(_expression(rest), None)], []))
            elif word in ("elif", "else"):
                arms, body = close("if")
                arms[-1] = (arms[-1][0], body)
                stack.append(("if", [*arms, (_expression(rest) if word == "elif" else Const(True), None)], []))
            elif word == "endif":
                arms, body = close("if")
                arms[-1] = (arms[-1][0], body)
                stack[-1][2].append(If(tuple(arms)))
            elif word == "set":
                if len(rest) < 3 or rest[1] != ("op", "="):
                    raise TemplateError(f"set NAME = VALUE: {m[2]!r}")
                stack[-1][2].append(Set(rest[0][1], _expression(rest[2:])))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endgeneration":
                _, body = close("generation")
                stack[-1][2].append(Generation(body))
            else:
                raise TemplateError(f"unknown block {word!r}")
    text(source[at:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    return tuple(stack[0][2])


# ---------------------------------------------------------------- constant folding

_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _shown(a) + _shown(b),
}


def _shown(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def folded(node: Any, filters: dict[str, Callable[[str], Any]]) -> Any:
    """The same tree with constants computed, dead arms gone and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in (folded(x, filters) for x in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.of, Const):
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].of, Const):
                        out[-1] = Output(Const(_shown(out[-1].of.value) + _shown(y.of.value)))
                    elif _shown(y.of.value):
                        out.append(Output(Const(_shown(y.of.value))))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Output):
        return Output(folded(node.of, filters))
    if isinstance(node, Item):
        of, key = folded(node.of, filters), folded(node.key, filters)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Unary):
        of = folded(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Unary(node.op, of)
    if isinstance(node, Binary):
        left, right = folded(node.left, filters), folded(node.right, filters)
        if node.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (node.op == "and") else left
        if node.op in _OPS and isinstance(left, Const) and isinstance(right, Const):
            return Const(_OPS[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        of = folded(node.of, filters)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, ListOf):
        items = tuple(folded(x, filters) for x in node.items)
        return Const([x.value for x in items]) if all(isinstance(x, Const) for x in items) else ListOf(items)
    if isinstance(node, For):
        return For(node.name, folded(node.over, filters), folded(node.body, filters))
    if isinstance(node, Set):
        return Set(node.name, folded(node.of, filters))
    if isinstance(node, Generation):
        return Generation(folded(node.body, filters))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            c = folded(condition, filters)
            if isinstance(c, Const) and not c.value:
                continue
            arms.append((c, folded(body, filters)))
            if isinstance(c, Const):
                break
        if arms and isinstance(arms[0][0], Const):
            return arms[0][1]
        return If(tuple(arms)) if arms else ()
    return node


# ---------------------------------------------------------------- closures


@dataclass
class _Scope:
    values: dict[str, Any] = field(default_factory=dict)
    trained: bool = False


def _value(node: Any, filters: dict[str, Callable[[str], Any]]) -> Callable[[_Scope], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda s: value
    if isinstance(node, Name):
        name = node.name
        return lambda s: s.values.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)
        return lambda s: _item(of(s), key(s))
    if isinstance(node, Unary):
        of = _value(node.of, filters)
        return lambda s: not of(s)
    if isinstance(node, Binary):
        left, right = _value(node.left, filters), _value(node.right, filters)
        if node.op == "and":
            return lambda s: left(s) and right(s)
        if node.op == "or":
            return lambda s: left(s) or right(s)
        op = _OPS[node.op]
        return lambda s: op(left(s), right(s))
    if isinstance(node, Filter):
        of, call = _value(node.of, filters), filters[node.name]
        return lambda s: call(of(s))
    if isinstance(node, ListOf):
        items = [_value(x, filters) for x in node.items]
        return lambda s: [x(s) for x in items]
    raise TemplateError(f"no value: {node!r}")


def _body(nodes: tuple, filters: dict[str, Callable[[str], Any]]) -> Callable[[_Scope], Iterator[tuple[str, bool]]]:
    steps = [_step(x, filters) for x in nodes]

    def run(s: _Scope) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(s)

    return run


def _step(node: Any, filters: dict[str, Callable[[str], Any]]) -> Callable[[_Scope], Iterable[tuple[str, bool]]]:
    if isinstance(node, Output):
        of = _value(node.of, filters)
        return lambda s: ((_shown(of(s)), s.trained),)
    if isinstance(node, Set):
        name, of = node.name, _value(node.of, filters)

        def put(s: _Scope) -> tuple:
            s.values[name] = of(s)
            return ()

        return put
    if isinstance(node, Generation):
        body = _body(node.body, filters)

        def trained(s: _Scope) -> Iterator[tuple[str, bool]]:
            was, s.trained = s.trained, True
            yield from body(s)
            s.trained = was

        return trained
    if isinstance(node, If):
        arms = [(_value(c, filters), _body(b, filters)) for c, b in node.arms]

        def choose(s: _Scope) -> Iterable[tuple[str, bool]]:
            return next((body(s) for condition, body in arms if condition(s)), ())

        return choose
    if isinstance(node, For):
        name, over, body = node.name, _value(node.over, filters), _body(node.body, filters)

        def loop(s: _Scope) -> Iterator[tuple[str, bool]]:
            outer = {k: s.values.get(k) for k in (name, "loop")}
            rest = iter(over(s) or ())
            nothing = object()
            item, previous, k = next(rest, nothing), None, 0
            while item is not nothing:
                following = next(rest, nothing)
                s.values[name] = item
                s.values["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": following is nothing, "previtem": previous, "nextitem": None if following is nothing else following}
                yield from body(s)
                previous, item, k = item, following, k + 1
            s.values |= outer

        return loop
    raise TemplateError(f"no block: {node!r}")


def compiled(source: str, filters: dict[str, Callable[[str], Any]] | None = None) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the template's names that yields (text, trained) pieces."""
    filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower} | (filters or {})
    run = _body(folded(parse(source), filters), filters)
    return lambda **names: run(_Scope(dict(names)))
