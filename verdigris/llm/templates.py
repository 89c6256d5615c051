"""A compiler for a small, sandboxed template language.

    text {{ expression }} {% if a %} {% elif b %} {% else %} {% endif %}
    {% for x in xs %} {% endfor %}  {% set x = expression %}
    {% generation %} what the model is trained on {% endgeneration %}

Expressions have literals, names, keys of mappings (a.b, a['b']), items of lists, + ~ == != < <= > >=,
in, not, and, or, `x if c else y`, and the filters given to the compiler.  There are no
calls and no attributes of Python objects, so a template can only read what it is given.
`loop.index`, `loop.index0`, `loop.first` and `loop.last` hold inside a loop.

The source is parsed to a syntax tree, constants are folded, and the tree becomes nested
Python closures; rendering gives the text and the spans of its generation blocks.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """kind: const, name, get, binary, not, and, or, choose, filter / text, output, if, for, set, generation."""

    kind: str
    value: Any = None
    parts: tuple = ()


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_LEX = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<word>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|]))")
_LITERALS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_COMPARE = {"==", "!=", "<", "<=", ">", ">=", "in"}


def _text(x: Any) -> str:
    return "" if x is None else str(x)


def _get(owner: Any, key: Any) -> Any:
    if isinstance(owner, dict):
        return owner.get(key)
    if isinstance(owner, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return owner[key] if -len(owner) <= key < len(owner) else None
    return None


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "get": _get,
}


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.filters = 0, filters

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted and self.peek() != wanted:
            raise TemplateError(f"{wanted or 'more'} expected")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Node:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> Node:
        out = self.either()
        if self.peek() == "if":
            self.take()
            condition = self.either()
            other = Node("const", None)
            if self.peek() == "else":
                self.take()
                other = self.choice()
            return Node("choose", None, (condition, out, other))
        return out

    def either(self) -> Node:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = Node("or", None, (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.peek() == "and":
            self.take()
            out = Node("and", None, (out, self.negated()))
        return out

    def negated(self) -> Node:
        if self.peek() == "not":
            self.take()
            return Node("not", None, (self.negated(),))
        out = self.sum()
        while True:
            if self.peek() in _COMPARE:
                op = self.take()[1]
                out = Node("binary", op, (out, self.sum()))
            elif self.peek() == "not":
                self.take()
                self.take("in")
                out = Node("not", None, (Node("binary", "in", (out, self.sum())),))
            else:
                return out

    def sum(self) -> Node:
        out = self.filtered()
        while self.peek() in ("+", "-", "~"):
            op = self.take()[1]
            out = Node("binary", op, (out, self.filtered()))
        return out

    def filtered(self) -> Node:
        out = self.primary()
        while self.peek() in (".", "[", "|"):
            mark = self.take()[1]
            if mark == "[":
                out = Node("binary", "get", (out, self.choice()))
                self.take("]")
                continue
            kind, name = self.take()
            if kind != "word":
                raise TemplateError(f"a name expected after {mark}")
            if mark == ".":
                out = Node("binary", "get", (out, Node("const", name)))
            elif name in self.filters:
                out = Node("filter", name, (out,))
            else:
                raise TemplateError(f"no filter {name!r}")
        return out

    def primary(self) -> Node:
        kind, value = self.take()
        if kind == "num":
            return Node("const", int(value))
        if kind == "str":
            return Node("const", ast.literal_eval(value))
        if kind == "word":
            return Node("const", _LITERALS[value]) if value in _LITERALS else Node("name", value)
        if value == "(":
            out = self.choice()
            self.take(")")
            return out
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: dict[str, Callable]) -> tuple[Node, ...]:
    """The syntax tree of a template: a tuple of statements."""
    items: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            items.append(("text", source[at : m.start()]))
        items.append(("output", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        items.append(("text", source[at:]))
    place = 0
    expression = lambda s: _Expression(s, filters).whole()

    def block(ends: tuple[str, ...]) -> tuple[tuple[Node, ...], str]:
        nonlocal place
        out: list[Node] = []
        while place < len(items):
            kind, body = items[place]
            place += 1
            if kind == "text":
                out.append(Node("text", body))
                continue
            if kind == "output":
                out.append(Node("output", None, (expression(body),)))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return tuple(out), body
            if word == "if":
                branches, condition = [], expression(rest)
                while True:
                    inner, end = block(("elif", "else", "endif"))
                    branches.append((condition, inner))
                    if end == "endif":
                        break
                    condition = expression(end[4:]) if end.startswith("elif") else Node("const", True)
                out.append(Node("if", None, tuple(branches)))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.DOTALL)
                if not m:
                    raise TemplateError(f"cannot read {body!r}")
                inner, _ = block(("endfor",))
                out.append(Node("for", m[1], (expression(m[2]), inner)))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise TemplateError(f"cannot read {body!r}")
                out.append(Node("set", name.strip(), (expression(value),)))
            elif word == "generation":
                inner, _ = block(("endgeneration",))
                out.append(Node("generation", None, (inner,)))
            else:
                raise TemplateError(f"no statement {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    return block(())[0]


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """An expression with its constant parts evaluated."""
    parts = tuple(fold(p, filters) for p in node.parts)
    node = Node(node.kind, node.value, parts)
    if node.kind in ("and", "or", "choose") and parts[0].kind == "const":
        if node.kind == "choose":
            return parts[1] if parts[0].value else parts[2]
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    if parts and all(p.kind == "const" for p in parts):
        values = [p.value for p in parts]
        if node.kind == "not":
            return Node("const", not values[0])
        if node.kind in ("binary", "filter"):
            work = _BINARY[node.value] if node.kind == "binary" else filters[node.value]
            try:
                return Node("const", work(*values))
            except TypeError as e:
                raise TemplateError(str(e)) from e
    return node


def simplify(statements: tuple[Node, ...], filters: dict[str, Callable]) -> tuple[Node, ...]:
    """Statements with folded expressions, dead branches gone and neighbouring texts joined."""
    out: list[Node] = []

    def add(node: Node) -> None:
        if node.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Node("text", out[-1].value + node.value)
        elif node.kind != "text" or node.value:
            out.append(node)

    for s in statements:
        if s.kind == "output":
            e = fold(s.parts[0], filters)
            add(Node("text", _text(e.value)) if e.kind == "const" else Node("output", None, (e,)))
        elif s.kind == "if":
            branches = []
            for condition, body in s.parts:
                e = fold(condition, filters)
                if e.kind == "const" and not e.value:
                    continue
                branches.append((e, simplify(body, filters)))
                if e.kind == "const":
                    break
            if branches and branches[0][0].kind == "const":
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(Node("if", None, tuple(branches)))
        elif s.kind == "for":
            add(Node("for", s.value, (fold(s.parts[0], filters), simplify(s.parts[1], filters))))
        elif s.kind == "set":
            add(Node("set", s.value, (fold(s.parts[0], filters),)))
        elif s.kind == "generation":
            add(Node("generation", None, (simplify(s.parts[0], filters),)))
        else:
            add(s)
    return tuple(out)


@dataclass
class _Output:
    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, s: str) -> None:
        self.pieces.append(s)
        self.length += len(s)


def _evaluator(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind, value = node.kind, node.value
    if kind == "const":
        return lambda names: value
    if kind == "name":
        return lambda names: names.get(value)
    parts = [_evaluator(p, filters) for p in node.parts]
    if kind == "choose":
        condition, yes, no = parts
        return lambda names: yes(names) if condition(names) else no(names)
    if kind == "not":
        (own,) = parts
        return lambda names: not own(names)
    if kind == "filter":
        (own,), work = parts, filters[value]
        return lambda names: work(own(names))
    left, right = parts
    if kind == "and":
        return lambda names: left(names) and right(names)
    if kind == "or":
        return lambda names: left(names) or right(names)
    work = _BINARY[value]
    return lambda names: work(left(names), right(names))


def _runner(statements: tuple[Node, ...], filters: dict[str, Callable]) -> Callable[[dict, _Output], None]:
    steps = [_step(s, filters) for s in statements]

    def run(names: dict, out: _Output) -> None:
        for step in steps:
            step(names, out)

    return run


def _step(s: Node, filters: dict[str, Callable]) -> Callable[[dict, _Output], None]:
    if s.kind == "text":
        literal = s.value
        return lambda names, out: out.write(literal)
    if s.kind == "output":
        value = _evaluator(s.parts[0], filters)
        return lambda names, out: out.write(_text(value(names)))
    if s.kind == "set":
        name, value = s.value, _evaluator(s.parts[0], filters)
        return lambda names, out: names.__setitem__(name, value(names))
    if s.kind == "if":
        branches = [(_evaluator(c, filters), _runner(b, filters)) for c, b in s.parts]

        def choose(names: dict, out: _Output) -> None:
            for condition, body in branches:
                if condition(names):
                    body(names, out)
                    return

        return choose
    if s.kind == "for":
        name, items, body = s.value, _evaluator(s.parts[0], filters), _runner(s.parts[1], filters)

        def loop(names: dict, out: _Output) -> None:
            values = items(names) or []
            for k, x in enumerate(values):
                own = names | {name: x, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(values) - 1}}
                body(own, out)

        return loop
    inner = _runner(s.parts[0], filters)

    def generation(names: dict, out: _Output) -> None:
        start = out.length
        inner(names, out)
        out.spans.append((start, out.length))

    return generation


class Template:
    """A compiled template; render gives its text and the (start, end) of its generation blocks, in code points."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = dict(filters or {})
        self.tree = simplify(parse(source, self.filters), self.filters)
        self._run = _runner(self.tree, self.filters)

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        self._run(names, out)
        return "".join(out.pieces), out.spans
