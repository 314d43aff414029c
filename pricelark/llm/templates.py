"""A small sandboxed template language, compiled to Python closures.

A source is parsed into a syntax tree, constants are folded, and the tree becomes
generators that yield ``(text, marked)`` pieces, where ``marked`` tells what stands inside
``{% generation %}``.  Statements: ``for x in messages``, ``if`` / ``elif`` / ``else``,
``set``, ``generation``; ``{{ expression }}``; ``{# comment #}``; a ``-`` inside a tag strips
white space beside it.  Expressions have literals, names, ``a.b`` and ``a['b']``, ``not and or``,
comparisons, ``in``, ``is defined``, ``+ - ~``, ``x if c else y`` and filters.

Sandbox: values are strings, numbers, booleans, nothing, dicts and lists; a dot looks up a dict's key
and never a Python attribute; there are no calls but filters, and no loop but over
``messages`` or a list inside a message.  Sources and nesting have a largest size.
``messages`` may be any iterator: it is read once, with one message of look-ahead, so a
conversation of any length takes the memory of two messages.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator

MOST_SOURCE, MOST_DEPTH = 100_000, 60
#: What a renderer yields after each turn of the loop over ``messages``.
TURN = ("", None)


class TemplateError(ValueError):
    pass


class _Undefined:
    def __str__(self):
        return ""

    def __bool__(self):
        return False


UNDEFINED = _Undefined()
_QUOTED = r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\""
_TAG = re.compile(rf"\{{#-?(?P<note>.*?)-?#\}}|\{{%(?P<lead>-?)(?P<tag>(?:{_QUOTED}|(?!-?%\}}).)*)(?P<trail>-?)%\}}|\{{\{{(?P<lead2>-?)(?P<out>(?:{_QUOTED}|(?!-?\}}\}}).)*)(?P<trail2>-?)\}}\}}", re.S)
_WORD = re.compile(rf"\s*(?:(?P<str>{_QUOTED})|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.,()\[\]=]))")
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def escape(text: str, controls: Iterable[str]) -> str:
    """A backslash before every backslash, and after the first code point of each control string, also where they overlap.

    No control string of two code points or more stands in the result; `unescape` gives the text back.
    """
    breaks = "|".join(rf"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True))
    return re.sub(rf"\\|{breaks}" if breaks else r"\\", lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v),
    "default": lambda v, other="": other if v is UNDEFINED else v, "replace": lambda v, a, b: _text(v).replace(a, b),
}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _get(value, key):
    if isinstance(value, dict):
        return value.get(key, UNDEFINED)
    if isinstance(value, (list, tuple, str)) and type(key) is int and -len(value) <= key < len(value):
        return value[key]
    return UNDEFINED


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str) or type(a) is int and type(b) is int:
        return a + b
    raise TemplateError(f"cannot add {type(a).__name__} and {type(b).__name__}")


def _subtract(a, b):
    if type(a) is int and type(b) is int:
        return a - b
    raise TemplateError("only whole numbers can be subtracted")


class _Expression:
    """Parses one expression into nested tuples whose first item names the node."""

    def __init__(self, source: str):
        self.words, at = [], 0
        while source[at:].strip():
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = self.depth = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] in ("op", "name") and self.words[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.words[self.at] if self.at < len(self.words) else ("", "")
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"a name is missing, or {value!r} is not allowed")
        self.at += 1
        return value

    def end(self, node):
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return node

    def whole(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        node = self.either()
        if self.take("if"):
            chosen = self.either()
            self.need("else")
            node = ("choose", chosen, node, self.whole())
        self.depth -= 1
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        times = 0
        while self.take("not"):
            times += 1
        node = self.compared()
        for _ in range(min(times, 2 - times % 2)):
            node = ("not", node)
        return node

    def compared(self):
        node = self.sum()
        while True:
            if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
                node = ("compare", op, node, self.sum())
            elif self.peek("not"):
                self.at += 1
                self.need("in")
                node = ("not", ("compare", "in", node, self.sum()))
            elif self.take("is"):
                no, test = bool(self.take("not")), self.take("defined", "none")
                if not test:
                    raise TemplateError("a test is 'defined' or 'none'")
                node = ("is", test, node)
                node = ("not", node) if no else node
            else:
                return node

    def sum(self):
        node = self.filtered()
        while op := self.take("+", "-", "~"):
            node = ({"+": "add", "-": "subtract", "~": "join"}[op], node, self.filtered())
        return node

    def filtered(self):
        node = self.postfix()
        while self.take("|"):
            name, args = self.name(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.whole())
                    if not self.peek(")"):
                        self.need(",")
            node = ("filter", name, node, tuple(args))
        return node

    def postfix(self):
        node = self.primary()
        while op := self.take(".", "["):
            node = ("get", node, ("constant", self.name()) if op == "." else self.whole())
            if op == "[":
                self.need("]")
        return node

    def primary(self):
        if self.take("("):
            node = self.whole()
            self.need(")")
            return node
        if self.at < len(self.words):
            kind, value = self.words[self.at]
            if kind == "int":
                self.at += 1
                return ("constant", int(value))
            if kind == "str":
                self.at += 1
                return ("constant", re.sub(r"(?s)\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
            if value.lower() in ("true", "false", "none") and kind == "name":
                self.at += 1
                return ("constant", {"true": True, "false": False, "none": None}[value.lower()])
        return ("name", self.name())


def parse(source: str) -> list:
    """The syntax tree: a list of statements."""
    if len(source) > MOST_SOURCE:
        raise TemplateError("the source is too long")
    pieces, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        lead, trail = m["lead"] or m["lead2"], m["trail"] or m["trail2"]
        pieces.append(("text", text.rstrip() if lead else text))
        if m["note"] is None:
            pieces.append(("tag", m["tag"].strip()) if m["tag"] is not None else ("out", m["out"]))
        at, strip = m.end(), bool(trail)
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    if any(kind == "text" and re.search(r"\{[%{#]", t) for kind, t in pieces):
        raise TemplateError("a tag isn't closed")
    body, at, end = _block(pieces, 0, (), 0)
    return body


def _block(pieces: list, at: int, ends: tuple, depth: int) -> tuple[list, int, str]:
    if depth > MOST_DEPTH:
        raise TemplateError("nested too deeply")
    body = []
    while at < len(pieces):
        kind, value = pieces[at]
        at += 1
        if kind == "text":
            body.append(("text", value))
            continue
        if kind == "out":
            body.append(("out", _whole(value)))
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return body, at, value
        if word == "for":
            name, _, over = rest.strip().partition(" in ")
            inner, at, _ = _block(pieces, at, ("endfor",), depth + 1)
            body.append(("for", _Expression(name).name(), _whole(over), inner))
        elif word == "if":
            arms, other, end = [], [], value
            while not end.startswith("end"):
                clause, at, following = _block(pieces, at, ("elif", "else", "endif"), depth + 1)
                if end == "else":
                    other = clause
                else:
                    arms.append((_whole(end.partition(" ")[2]), clause))
                end = following
            body.append(("if", arms, other))
        elif word == "set":
            name, _, made = rest.partition("=")
            body.append(("set", _Expression(name).name(), _whole(made)))
        elif word == "generation":
            inner, at, _ = _block(pieces, at, ("endgeneration",), depth + 1)
            body.append(("mark", inner))
        else:
            raise TemplateError(f"unknown statement {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return body, at, ""


def _whole(source: str):
    e = _Expression(source)
    return e.end(e.whole())


def _folded(node: tuple, known: dict, filters: dict) -> tuple:
    """An expression with constant parts evaluated; ``known`` names are constants."""
    kind = node[0]
    if kind == "constant":
        return node
    if kind == "name":
        return ("constant", known[node[1]]) if node[1] in known else node
    sub = lambda x: _folded(x, known, filters) if isinstance(x, tuple) and x and isinstance(x[0], str) else tuple(sub(y) for y in x) if isinstance(x, tuple) else x
    node = (kind, *(sub(x) for x in node[1:]))
    if kind in ("and", "or") and node[1][0] == "constant":
        return node[2] if bool(node[1][1]) == (kind == "and") else node[1]
    if kind == "choose" and node[1][0] == "constant":
        return node[2] if node[1][1] else node[3]
    parts = [x for x in node[1:] if isinstance(x, tuple)]
    flat = [y for x in parts for y in (x if not x or isinstance(x[0], tuple) else (x,))]
    return ("constant", _closure(node, filters)({})) if all(x[0] == "constant" for x in flat) else node


def fold(body: list, known: dict, filters: dict) -> list:
    """The tree with constants folded: dead branches go, neighbouring texts become one."""
    out: list = []

    def text(value: str) -> None:
        if value and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value)
        elif value:
            out.append(("text", value))

    known = {k: v for k, v in known.items() if k not in _assigned(body)}
    for node in body:
        if node[0] == "text":
            text(node[1])
        elif node[0] == "out":
            e = _folded(node[1], known, filters)
            text(_text(e[1])) if e[0] == "constant" else out.append(("out", e))
        elif node[0] == "if":
            arms, other = [], node[2]
            for test, clause in node[1]:
                test = _folded(test, known, filters)
                if test[0] != "constant":
                    arms.append((test, fold(clause, known, filters)))
                elif test[1]:
                    other = clause
                    break
            other = fold(other, known, filters)
            if arms:
                out.append(("if", arms, other))
            else:
                for x in other:
                    text(x[1]) if x[0] == "text" else out.append(x)
        elif node[0] == "for":
            inner = {k: v for k, v in known.items() if k not in (node[1], "loop")}
            out.append(("for", node[1], _folded(node[2], known, filters), fold(node[3], inner, filters)))
        elif node[0] == "set":
            out.append(("set", node[1], _folded(node[2], known, filters)))
        elif inner := fold(node[1], known, filters):
            out.append(("mark", inner))
    return out


def _assigned(body: list) -> set[str]:
    names = set()
    for node in body:
        if node[0] == "set":
            names.add(node[1])
        for inner in {"for": lambda n: [n[3]], "mark": lambda n: [n[1]], "if": lambda n: [*(c for _, c in n[1]), n[2]]}.get(node[0], lambda n: [])(node):
            names |= _assigned(inner)
    return names


def _closure(node: tuple, filters: dict) -> Callable[[dict], object]:
    """A function of the scope that gives the expression's value."""
    kind = node[0]
    sub = lambda x: _closure(x, filters)
    if kind == "constant":
        return lambda scope, value=node[1]: value
    if kind == "name":
        return lambda scope, name=node[1]: scope.get(name, UNDEFINED)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        f, value, args = filters[node[1]], sub(node[2]), [sub(x) for x in node[3]]
        return (lambda scope: f(value(scope), *(a(scope) for a in args))) if args else lambda scope: f(value(scope))
    if kind == "compare":
        f, a, b = _COMPARE[node[1]], sub(node[2]), sub(node[3])
        return lambda scope: f(a(scope), b(scope))
    if kind == "is":
        value = sub(node[2])
        return (lambda scope: value(scope) is not UNDEFINED) if node[1] == "defined" else lambda scope: value(scope) is None
    if kind == "not":
        value = sub(node[1])
        return lambda scope: not value(scope)
    a, b = sub(node[1]), sub(node[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "choose":
        c = sub(node[3])
        return lambda scope: b(scope) if a(scope) else c(scope)
    two = {"get": _get, "add": _add, "subtract": _subtract, "join": lambda x, y: _text(x) + _text(y)}[kind]
    return lambda scope: two(a(scope), b(scope))


def _ahead(items: Iterable) -> Iterator[dict]:
    """(loop variables, item) of each item, with one item of look-ahead."""
    before, items = UNDEFINED, iter(items)
    item = next(items, UNDEFINED)
    index = 0
    while item is not UNDEFINED:
        after = next(items, UNDEFINED)
        yield {"index": index + 1, "index0": index, "first": index == 0, "last": after is UNDEFINED, "previtem": before, "nextitem": after}, item
        before, item, index = item, after, index + 1


def _generator(body: list, filters: dict, marked: bool = False) -> Callable[[dict], Iterator[tuple]]:
    """A function of the scope that yields the body's pieces."""
    steps = []
    for node in body:
        if node[0] == "text":
            steps.append(lambda scope, piece=(node[1], marked): (piece,))
        elif node[0] == "out":
            steps.append(lambda scope, value=_closure(node[1], filters): ((_text(value(scope)), marked),))
        elif node[0] == "set":
            def put(scope, name=node[1], value=_closure(node[2], filters)):
                scope[name] = value(scope)
                return ()
            steps.append(put)
        elif node[0] == "mark":
            steps.append(_generator(node[1], filters, True))
        elif node[0] == "if":
            arms = [(_closure(test, filters), _generator(clause, filters, marked)) for test, clause in node[1]]
            def choose(scope, arms=arms, other=_generator(node[2], filters, marked)):
                return next((clause(scope) for test, clause in arms if test(scope)), None) or other(scope)
            steps.append(choose)
        else:
            turns = node[2] == ("name", "messages")
            def loop(scope, name=node[1], over=_closure(node[2], filters), inner=_generator(node[3], filters, marked), turns=turns):
                items = over(scope)
                if not turns and not isinstance(items, (list, tuple)):
                    raise TemplateError("only messages and lists can be looped over")
                for state, item in _ahead(items):
                    yield from inner({**scope, name: item, "loop": state})
                    if turns:
                        yield TURN
            steps.append(loop)

    def run(scope: dict) -> Iterator[tuple]:
        for step in steps:
            yield from step(scope)

    return run


def _uses(tree, inside: bool = False) -> list[bool]:
    """For each use of ``messages``: whether it is what a loop outside all loops runs over."""
    if isinstance(tree, tuple) and tree[:2] == ("name", "messages"):
        return [False]
    if isinstance(tree, tuple) and tree and tree[0] == "for":
        own = [not inside] if tree[2] == ("name", "messages") else _uses(tree[2], inside)
        return own + _uses(tree[3], True)
    return [x for part in tree for x in _uses(part, inside)] if isinstance(tree, (list, tuple)) else []


class Template:
    """A compiled source.  ``controls`` are the strings that ``escape`` breaks up; ``constants`` are folded in."""

    def __init__(self, source: str, controls: Iterable[str] = (), constants: dict | None = None):
        controls = tuple(controls)
        self.filters = FILTERS | {"escape": lambda v, *more: escape(_text(v), (*controls, *more))}
        self.tree = fold(parse(source), constants or {}, self.filters)
        uses = _uses(self.tree)
        if not all(uses) or len(uses) > 1:
            raise TemplateError("messages may be looped over once, outside other loops, and not used otherwise")
        self._run = _generator(self.tree, self.filters)

    def pieces(self, messages: Iterable[dict], **values) -> Iterator[tuple]:
        """(text, marked) pieces, and `TURN` after each message."""
        return self._run({**values, "messages": messages})

    def parts(self, messages: Iterable[dict], most_chars: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, marked spans) of the output, cut after the turn with which a part reaches ``most_chars`` characters."""
        held, spans, size = [], [], 0
        for piece in self.pieces(messages):
            if piece is TURN:
                if size >= most_chars:
                    yield "".join(held), spans
                    held, spans, size = [], [], 0
                continue
            text, marked = piece
            if marked and text:
                if spans and spans[-1][1] == size:
                    spans[-1] = (spans[-1][0], size + len(text))
                else:
                    spans.append((size, size + len(text)))
            held.append(text)
            size += len(text)
        if held:
            yield "".join(held), spans

    def render(self, messages: Iterable[dict], **values) -> str:
        return "".join(text for text, _ in self.pieces(messages, **values))
