"""A compiler for a small, sandboxed template language.

``parse`` builds a syntax tree, ``fold`` evaluates what is constant, and ``compile_template``
turns the tree into Python closures that yield (text, is_generated) pieces.

Language: text; ``{{ expr }}``; ``{% for x in expr %} .. {% endfor %}``; ``{% if %} .. {% elif %} ..
{% else %} .. {% endif %}``; ``{% set x = expr %}``; ``{% generation %} .. {% endgeneration %}``;
``{# comment #}``; a ``-`` inside a tag trims the white space on its side. Expressions: literals,
names, ``a.key``, ``a[expr]``, ``|filter``, ``not and or``, comparisons, ``in``, ``+``, ``~``.

Sandbox: there are no calls and no attributes of Python objects. A dot reads a key of a mapping or
one of ``loop``'s four values; names with a leading underscore don't parse.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """A template that doesn't parse, or reads what isn't there."""


_TAG = re.compile(r"\{(?:\{(-?)(.*?)(-?)\}|%(-?)(.*?)(-?)%|#(-?).*?(-?)#)\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-<>+~|.\[\]()=]))")
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_CONSTANTS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _as_text(x) -> str:
    return "" if x is None else str(x)


FILTERS: dict[str, Callable] = {"trim": lambda x: _as_text(x).strip(), "upper": lambda x: _as_text(x).upper(), "lower": lambda x: _as_text(x).lower(), "length": len}


# --- expressions -------------------------------------------------------------------------------

class _Expressions:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected character in {source!r} at {at}")
            number, text, name, sign = m.groups()
            if name and name.startswith("_"):
                raise TemplateError(f"name {name!r} is not allowed")
            self.tokens.append(("number", int(number)) if number else ("text", re.sub(r"\\(.)", lambda k: _ESCAPES.get(k[1], k[1]), text[1:-1], flags=re.S)) if text else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.tokens.append(("end", None))
        self.at = 0

    def take(self, *wanted) -> tuple | None:
        if self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, kind: str, value=None):
        k, v = self.tokens[self.at]
        if k != kind or value not in (None, v):
            raise TemplateError(f"expected {value or kind} in {self.source!r}")
        self.at += 1
        return v

    def whole(self):
        tree = self.either()
        self.need("end")
        return tree

    def either(self):
        tree = self.both()
        while self.take(("name", "or")):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take(("name", "and")):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take(("name", "not")) else self.compared()

    def compared(self):
        tree = self.joined()
        while True:
            if sign := self.take(*(("sign", s) for s in _COMPARE)):
                tree = ("compare", sign[1], tree, self.joined())
            elif self.take(("name", "in")):
                tree = ("in", tree, self.joined())
            elif self.tokens[self.at : self.at + 2] == [("name", "not"), ("name", "in")]:
                self.at += 2
                tree = ("not", ("in", tree, self.joined()))
            else:
                return tree

    def joined(self):
        tree = self.followed()
        while sign := self.take(("sign", "+"), ("sign", "~")):
            tree = ("add" if sign[1] == "+" else "concat", tree, self.followed())
        return tree

    def followed(self):
        tree = self.single()
        while sign := self.take(("sign", "."), ("sign", "["), ("sign", "|")):
            if sign[1] == ".":
                tree = ("item", tree, ("const", self.need("name")))
            elif sign[1] == "[":
                tree = ("item", tree, self.either())
                self.need("sign", "]")
            else:
                tree = ("filter", self.need("name"), tree)
        return tree

    def single(self):
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("number", "text"):
            return ("const", value)
        if kind == "name":
            return ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        if (kind, value) == ("sign", "("):
            tree = self.either()
            self.need("sign", ")")
            return tree
        raise TemplateError(f"unexpected {value!r} in {self.source!r}")


# --- statements --------------------------------------------------------------------------------

def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of statements."""
    parts: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        left, right = m[1] or m[4] or m[7], m[3] or m[6] or m[8]
        text = text.lstrip() if trim else text
        parts.append(("text", text.rstrip() if left else text))
        parts += [("print", m[2])] if m[2] is not None else [("tag", m[5].strip())] if m[5] is not None else []
        at, trim = m.end(), bool(right)
    parts.append(("text", source[at:].lstrip() if trim else source[at:]))
    position = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal position
        out: list[tuple] = []
        while position < len(parts):
            kind, value = parts[position]
            position += 1
            word, _, rest = value.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "text":
                out += [("text", value)] if value else []
            elif kind == "print":
                out.append(("print", _Expressions(value).whole()))
            elif word in ends:
                return out, value
            elif word == "for":
                if not (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                    raise TemplateError(f"bad loop: {value!r}")
                body, _ = block("endfor")
                out.append(("for", m[1], _Expressions(m[2]).whole(), body))
            elif word == "if":
                branches, condition = [], _Expressions(rest).whole()
                while True:
                    body, end = block("elif", "else", "endif")
                    branches.append((condition, body))
                    if end == "endif":
                        break
                    condition = ("const", True) if end == "else" else _Expressions(end.partition(" ")[2]).whole()
                out.append(("if", branches))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError(f"bad name: {name!r}")
                out.append(("set", name.strip(), _Expressions(value).whole()))
            elif word == "generation":
                body, _ = block("endgeneration")
                out.append(("generation", body))
            else:
                raise TemplateError(f"unknown tag: {value!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return block()[0]


# --- folding -----------------------------------------------------------------------------------

def fold_expression(tree: tuple, filters: Mapping[str, Callable]) -> tuple:
    if tree[0] in ("const", "name"):
        return tree
    tree = tuple(fold_expression(x, filters) if isinstance(x, tuple) else x for x in tree)
    if all(x[0] == "const" for x in tree if isinstance(x, tuple)):
        try:
            return ("const", _expression(tree, filters)({}))
        except TypeError:  # fails where it is rendered, if it ever is
            return tree
    return tree


def fold(statements: list[tuple], filters: Mapping[str, Callable] = FILTERS) -> list[tuple]:
    """Constant expressions become values, dead branches go, neighbouring texts join."""
    out: list[tuple] = []

    def add(x: tuple) -> None:
        if x[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + x[1])
        elif x != ("text", ""):
            out.append(x)

    for kind, *rest in statements:
        if kind == "print":
            tree = fold_expression(rest[0], filters)
            add(("text", _as_text(tree[1])) if tree[0] == "const" else ("print", tree))
        elif kind == "if":
            branches = []
            for condition, body in rest[0]:
                condition = fold_expression(condition, filters)
                if condition[0] != "const" or condition[1]:
                    branches.append((condition, fold(body, filters)))
                if condition[0] == "const" and condition[1]:
                    break
            if branches and branches[0][0][0] == "const":
                for x in branches[0][1]:
                    add(x)
            elif branches:
                add(("if", branches))
        elif kind == "for":
            add(("for", rest[0], fold_expression(rest[1], filters), fold(rest[2], filters)))
        elif kind == "set":
            add(("set", rest[0], fold_expression(rest[1], filters)))
        elif kind == "generation":
            add(("generation", fold(rest[0], filters)))
        else:
            add((kind, *rest))
    return out


# --- closures ----------------------------------------------------------------------------------

def _item(of, key):
    if isinstance(of, Mapping) and key in of or isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool) and -len(of) <= key < len(of):
        return of[key]
    raise TemplateError(f"no item {key!r}")


def _expression(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    kind, *rest = tree
    if kind == "const":
        return lambda scope, value=rest[0]: value
    if kind == "name":
        def read(scope, name=rest[0]):
            if name not in scope:
                raise TemplateError(f"unknown name {name!r}")
            return scope[name]
        return read
    if kind == "filter":
        if rest[0] not in filters:
            raise TemplateError(f"unknown filter {rest[0]!r}")
        f, x = filters[rest[0]], _expression(rest[1], filters)
        return lambda scope: f(x(scope))
    if kind == "compare":
        f, x, y = _COMPARE[rest[0]], _expression(rest[1], filters), _expression(rest[2], filters)
        return lambda scope: f(x(scope), y(scope))
    if kind == "not":
        x = _expression(rest[0], filters)
        return lambda scope: not x(scope)
    x, y = (_expression(t, filters) for t in rest)
    return {
        "or": lambda scope: x(scope) or y(scope),
        "and": lambda scope: x(scope) and y(scope),
        "in": lambda scope: x(scope) in y(scope),
        "add": lambda scope: x(scope) + y(scope),
        "concat": lambda scope: _as_text(x(scope)) + _as_text(y(scope)),
        "item": lambda scope: _item(x(scope), y(scope)),
    }[kind]


def _body(statements: list[tuple], filters: Mapping[str, Callable]) -> Callable[[dict, bool], Iterator[Piece]]:
    steps = [_statement(s, filters) for s in statements]

    def run(scope: dict, generated: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, generated)

    return run


def _statement(statement: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, bool], Iterable[Piece]]:
    kind, *rest = statement
    if kind == "text":
        return lambda scope, generated, text=rest[0]: ((text, generated),)
    if kind == "print":
        x = _expression(rest[0], filters)
        return lambda scope, generated: ((_as_text(x(scope)), generated),)
    if kind == "set":
        x = _expression(rest[1], filters)
        return lambda scope, generated, name=rest[0]: scope.__setitem__(name, x(scope)) or ()
    if kind == "generation":
        inner = _body(rest[0], filters)
        return lambda scope, generated: inner(scope, True)
    if kind == "if":
        branches = [(_expression(c, filters), _body(b, filters)) for c, b in rest[0]]
        return lambda scope, generated: next((b(scope, generated) for c, b in branches if c(scope)), ())
    name, source, inner = rest[0], _expression(rest[1], filters), _body(rest[2], filters)

    def loop(scope: dict, generated: bool) -> Iterator[Piece]:
        rows, index = iter(source(scope)), 0
        ahead = next(rows, loop)
        while ahead is not loop:  # one row is read ahead, for loop.last
            row, ahead = ahead, next(rows, loop)
            own = dict(scope)
            own[name] = row
            own["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is loop}
            yield from inner(own, generated)
            index += 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of the template's variables that yields (text, is_generated) pieces."""
    known = {**FILTERS, **(filters or {})}
    run = _body(fold(parse(source), known), known)
    return lambda **scope: run(scope, False)
