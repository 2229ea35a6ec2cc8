"""Chat formatting with a template compiler.

A sandboxed template language is parsed into a syntax tree, constants are
folded, neighbouring literals merged and branches on constants dropped, and the
tree becomes nested Python closures (no generated source, no ``eval``).

Language: ``{{ expression }}``; ``{% if/elif/else/endif %}``; ``{% for x, y in e
if c %}..{% else %}..{% endfor %}`` with ``loop``, ``break`` and ``continue``;
``{% set x = e %}``, ``{% set n.x = e %}`` on a ``namespace(...)`` and ``{% set x
%}..{% endset %}``; ``{% macro f(a, b=1) %}..{% endmacro %}``; ``{% generation
%}..{% endgeneration %}`` around what a model should learn; ``{# #}`` and ``-``
inside a tag to trim the white space before or after it (``blocks`` also drops
the line break after a block tag and the blanks before it).  Expressions have
literals, lists, tuples, mappings, ``a.b``, ``a['b']``, slices, ``+ - * / // % ~``, comparisons,
``in``, ``is [not]`` a test of ``TESTS``, ``and or not``, ``x if c else y``, the
filters of ``FILTERS``, the methods of ``METHODS`` and the functions ``namespace``,
``dict``, ``range`` and ``raise_exception``.  Names resolve in the given variables
and nowhere else; attributes are keys of mappings only; nothing else can be
called.  What isn't in this language is a ``TemplateError`` when compiled, and an
attribute of nothing one when rendered; neither is ever rendered as empty text.
``none`` and undefined names are put as empty text.

Cases: a conversation's turns are ordered by turn, role and text; a null text
or role is an empty string; a null turn comes first; each turn with a null
conversation id is a conversation of its own; repeated turns are all rendered;
texts of any length are rendered whole; other columns, whatever their names,
are ignored; an empty table gives no rows.  A conversation is one row of the
result and is brought together in one place for it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHATML = (
    "{% for message in messages %}{{ '<|im_start|>' + message.role + '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content + '<|im_end|>' }}{% endgeneration %}"
    "{% else %}{{ message.content + '<|im_end|>' }}{% endif %}{{ '\\n' }}{% endfor %}"
)
class TemplateError(ValueError):
    pass


class _Undefined:
    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False

    def __iter__(self) -> Iterator:
        return iter(())

    def __len__(self) -> int:
        return 0


UNDEFINED = _Undefined()


class _Loop(dict):
    """The fixed fields of a loop; others are errors."""


class _Namespace(dict):
    """A mapping that ``{% set n.x = e %}`` changes."""


def _text(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x)


def _where(want: bool) -> Callable:
    def select(rows: Any, key: Any, test: str = "", *args: Any) -> list:
        return [r for r in rows if bool(_test(test)(_item(r, key), *args) if test else _item(r, key)) == want]

    return select


def _map(rows: Any, name: Any = None, *args: Any, attribute: Any = None, default: Any = UNDEFINED) -> list:
    if attribute is not None:
        got = [_item(r, attribute) for r in rows]
        return [default if g is UNDEFINED else g for g in got]
    if name not in FILTERS:
        raise TemplateError(f"no filter {name!r}")
    return [FILTERS[name](r, *args) for r in rows]


def _json(x: Any, indent: int | None = None, ensure_ascii: bool = False, separators: Any = None, sort_keys: bool = False) -> str:
    return json.dumps(x, ensure_ascii=ensure_ascii, indent=indent, separators=separators, sort_keys=sort_keys)


def _sort(rows: Any, reverse: bool = False, case_sensitive: bool = False, attribute: Any = None) -> list:
    def key(r: Any) -> Any:
        v = r if attribute is None else _item(r, attribute)
        return v if case_sensitive or not isinstance(v, str) else v.lower()

    return sorted(rows, key=key, reverse=reverse)


FILTERS: dict[str, Callable] = {
    "trim": lambda s, chars=None: _text(s).strip(chars), "upper": lambda s: _text(s).upper(), "lower": lambda s: _text(s).lower(), "capitalize": lambda s: _text(s).capitalize(), "title": lambda s: _text(s).title(),
    "length": len, "count": len, "string": str, "int": lambda x, d=0: int(x) if str(x).strip().lstrip("+-").isdigit() or isinstance(x, float) else d, "float": float, "abs": abs, "round": lambda x, n=0: round(float(x), n), "tojson": _json, "safe": lambda x: x,
    "first": lambda x: next(iter(x), UNDEFINED), "last": lambda x: list(x)[-1] if len(x) else UNDEFINED, "list": list, "reverse": lambda x: x[::-1] if isinstance(x, str) else list(x)[::-1], "unique": lambda x: list(dict.fromkeys(x)), "sum": sum, "min": min, "max": max, "sort": _sort,
    "default": lambda x, d="", boolean=False: d if x is UNDEFINED or (boolean and not x) else x, "join": lambda x, d="": _text(d).join(map(_text, x)), "replace": lambda s, a, b: _text(s).replace(a, b), "split": lambda s, by=None: _text(s).split(by),
    "items": lambda x: list(x.items()) if isinstance(x, Mapping) else [], "dictsort": lambda x: sorted(x.items()), "selectattr": _where(True), "rejectattr": _where(False), "map": _map,
    "indent": lambda s, n=4, first=False: (" " * n if first else "") + _text(s).replace("\n", "\n" + " " * n),
}
FILTERS["d"] = FILTERS["default"]
#: The methods of texts and of mappings that may be called.
METHODS = {
    str: {"strip", "lstrip", "rstrip", "upper", "lower", "title", "capitalize", "startswith", "endswith", "replace", "split", "rsplit", "splitlines", "find", "rfind", "count", "join", "isdigit", "isalpha", "isspace", "removeprefix", "removesuffix", "partition", "rpartition"},
    Mapping: {"items", "keys", "values", "get"},
    _Loop: {"cycle"},
}
TESTS: dict[str, Callable] = {
    "defined": lambda x: x is not UNDEFINED, "undefined": lambda x: x is UNDEFINED, "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, Mapping), "boolean": lambda x: isinstance(x, bool),
    "number": lambda x: isinstance(x, (int, float)), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool), "float": lambda x: isinstance(x, float), "iterable": lambda x: isinstance(x, (str, list, tuple, Mapping)), "sequence": lambda x: isinstance(x, (str, list, tuple, Mapping)),
    "true": lambda x: x is True, "false": lambda x: x is False, "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0, "divisibleby": lambda x, n: x % n == 0, "equalto": lambda x, y: x == y, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "in": lambda x, y: x in y,
}


def _test(name: str) -> Callable:
    made = {"==": "eq", "!=": "ne"}.get(name, name)
    if made not in TESTS:
        raise TemplateError(f"no test {name!r}")
    return TESTS[made]


def _range(*at: int) -> list[int]:
    if len(got := range(*at)) > 100_000:
        raise TemplateError("a range is too long")
    return list(got)


def _raise(message: Any = "") -> Any:
    raise TemplateError(str(message))


#: Their results differ from call to call or are errors, so they are never folded.
FUNCTIONS: dict[str, Callable] = {"namespace": lambda *a, **k: _Namespace(*a, **k), "dict": dict, "range": _range, "raise_exception": _raise}

_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*/%~<>()\[\]{}.,|:=])|(\S))", re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r"}
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b, "~": lambda a, b: _text(a) + _text(b),
}
_LEVELS = [("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "/", "//", "%")]
_RESERVED = {"if", "else", "elif", "in", "is", "not", "and", "or", "for"}


def _item(a: Any, b: Any) -> Any:
    if a is UNDEFINED:
        raise TemplateError(f"{b!r} of something undefined")
    try:
        return a[b] if isinstance(a, Mapping) or (isinstance(a, (list, tuple, str)) and isinstance(b, int)) else UNDEFINED
    except (KeyError, IndexError):
        if isinstance(a, _Loop):
            raise TemplateError(f"loops have no {b!r}") from None
        return UNDEFINED


def _slice(a: Any, start: Any, stop: Any, step: Any) -> Any:
    if not isinstance(a, (list, tuple, str)):
        raise TemplateError("only texts and lists have slices")
    return a[start:stop:step]


def _method(name: str) -> Callable:
    def call(a: Any, *args: Any, **named: Any) -> Any:
        if isinstance(a, _Loop) and name == "cycle":
            return args[a["index0"] % len(args)]
        kind = next((t for t in (str, Mapping) if isinstance(a, t) and name in METHODS[t]), None)
        if kind is None:
            raise TemplateError(f"{type(a).__name__} has no method {name!r}")
        got = getattr(a, name)(*args, **named)
        return list(got) if kind is Mapping and name != "get" else got

    return call


def _named(f: Callable, names: list[str]) -> Callable:
    """``f`` with its last arguments by name."""
    if not names:
        return f
    return lambda *args: f(*args[: -len(names)], **dict(zip(names, args[-len(names) :])))


class _Expression:
    """Recursive descent to ``('const', v) | ('name', n) | ('call', function, [nodes]) | ('do', name, [nodes], names) | ('and'|'or', a, b) | ('if', c, a, b)``."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        for number, string, name, sign, bad in _TOKEN.findall(text.rstrip()):
            if bad:
                raise TemplateError(f"unexpected {bad!r} in {text!r}")
            if number:
                self.tokens.append(("const", float(number) if "." in number else int(number)))
            elif string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("name" if name else "sign", name or sign))
        self.i = 0

    def peek(self, *words: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][0] != "const" and self.tokens[self.i][1] in words

    def accept(self, *words: str) -> str:
        if self.peek(*words):
            self.i += 1
            return self.tokens[self.i - 1][1]
        return ""

    def expect(self, word: str) -> None:
        if not self.accept(word):
            raise TemplateError(f"{word!r} is missing")

    def name(self) -> str:
        if self.i >= len(self.tokens) or self.tokens[self.i][0] != "name":
            raise TemplateError("a name is missing")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def arguments(self) -> tuple[list[tuple], list[str]]:
        """What is between parentheses, of which the left one is taken: values and the names of the last ones."""
        values, names = [], []
        while not self.accept(")"):
            if self.i + 1 < len(self.tokens) and self.tokens[self.i][0] == "name" and self.tokens[self.i + 1] == ("sign", "="):
                names.append(self.name())
                self.i += 1
            elif names:
                raise TemplateError("an argument without a name after one with")
            values.append(self.choice())
            if not self.accept(",") and not self.peek(")"):
                raise TemplateError("')' is missing")
        return values, names

    def items(self, end: str) -> list[tuple]:
        parts = []
        while not self.accept(end):
            parts.append(self.choice())
            if not self.accept(",") and not self.peek(end):
                raise TemplateError(f"{end!r} is missing")
        return parts

    def whole(self) -> tuple:
        node = self.choice()
        if self.peek(","):
            parts = [node]
            while self.accept(","):
                if self.i < len(self.tokens):
                    parts.append(self.choice())
            node = ("call", lambda *x: tuple(x), parts)
        if self.i < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.i][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.accept("if"):
            test = self.either()
            other = self.choice() if self.accept("else") else ("const", UNDEFINED)
            return ("if", test, node, other)
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.accept("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.accept("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("call", lambda x: not x, [self.negated()]) if self.accept("not") else self.level(0)

    def level(self, n: int) -> tuple:
        if n == len(_LEVELS):
            return self.unary()
        node = self.level(n + 1)
        while True:
            if n == 0 and self.accept("is"):
                negate = bool(self.accept("not"))
                test, args = _test(self.name()), []
                if self.accept("("):
                    args = self.arguments()[0]
                elif self.i < len(self.tokens) and (self.tokens[self.i][0] == "const" or (self.tokens[self.i][0] == "name" and self.tokens[self.i][1] not in _RESERVED)):
                    args = [self.unary()]
                node = ("call", (lambda *x, t=test: not t(*x)) if negate else test, [node, *args])
                continue
            start = self.i
            sign = self.accept(*_LEVELS[n])
            if n == 0 and not sign and self.accept("not"):
                sign = "not in" if self.accept("in") else ""
                if not sign:
                    self.i = start
            if not sign:
                return node
            node = ("call", _BINARY[sign], [node, self.level(n + 1)])

    def unary(self) -> tuple:
        if self.accept("-"):
            return ("call", lambda x: -x, [self.unary()])
        node = self.atom()
        while True:
            if self.accept("."):
                name = self.name()
                if self.accept("("):
                    if not any(name in m for m in METHODS.values()):
                        raise TemplateError(f"no method {name!r}")
                    args, names = self.arguments()
                    node = ("call", _named(_method(name), names), [node, *args])
                elif name.startswith("_"):
                    raise TemplateError(f"no attribute {name!r}")
                else:
                    node = ("call", _item, [node, ("const", name)])
            elif self.accept("["):
                parts: list[tuple] = []
                while not self.peek("]"):
                    parts.append(("const", None) if self.peek(":") else self.choice())
                    if not self.accept(":"):
                        break
                    if self.peek("]"):
                        parts.append(("const", None))
                self.expect("]")
                if not 1 <= len(parts) <= 3:
                    raise TemplateError("bad index")
                node = ("call", _item, [node, *parts]) if len(parts) == 1 else ("call", _slice, [node, *parts, *[("const", None)] * (3 - len(parts))])
            elif self.accept("|"):
                made = FILTERS.get(name := self.name())
                if made is None:
                    raise TemplateError(f"no filter {name!r}")
                args, names = self.arguments() if self.accept("(") else ([], [])
                node = ("call", _named(made, names), [node, *args])
            elif self.peek("(") and node[0] == "name":
                self.i += 1
                node = ("do", node[1], *self.arguments())
            else:
                return node

    def atom(self) -> tuple:
        if self.i >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.i]
        self.i += 1
        if kind == "const":
            return ("const", value)
        if kind == "name":
            words = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            if value in _RESERVED:
                raise TemplateError(f"unexpected {value!r}")
            return ("const", words[value]) if value in words else ("name", value)
        if value == "(":
            if self.accept(")"):
                return ("const", ())
            node = self.choice()
            if not self.peek(","):
                self.expect(")")
                return node
            self.accept(",")
            return ("call", lambda *x: tuple(x), [node, *self.items(")")])
        if value == "[":
            return ("call", lambda *x: list(x), self.items("]"))
        if value == "{":
            parts = []
            while not self.accept("}"):
                parts.append(self.choice())
                self.expect(":")
                parts.append(self.choice())
                if not self.accept(",") and not self.peek("}"):
                    raise TemplateError("'}' is missing")
            return ("call", lambda *x: dict(zip(x[::2], x[1::2])), parts)
        raise TemplateError(f"unexpected {value!r}")


def fold(node: tuple) -> tuple:
    """``node`` with every part that has no name replaced by its value; what fails stays, to fail when rendered."""
    kind = node[0]
    if kind == "call":
        parts = [fold(x) for x in node[2]]
        if all(p[0] == "const" for p in parts):
            try:
                return ("const", node[1](*[p[1] for p in parts]))
            except Exception:  # noqa: BLE001
                pass
        return ("call", node[1], parts)
    if kind == "do":
        return ("do", node[1], [fold(x) for x in node[2]], node[3])
    if kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    return node


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        const = node[1]
        return lambda env: const
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name, UNDEFINED)
    if kind == "call":
        f, parts = node[1], [_value(x) for x in node[2]]
        if len(parts) == 2:
            a, b = parts
            return lambda env: f(a(env), b(env))
        return lambda env: f(*[p(env) for p in parts])
    if kind == "do":
        name, parts, names = node[1], [_value(x) for x in node[2]], node[3]

        def do(env: dict) -> Any:
            f = env.get(name, FUNCTIONS.get(name))
            if not isinstance(f, _Macro) and (f is None or f is not FUNCTIONS.get(name)):
                raise TemplateError(f"{name!r} can't be called")
            return _named(f, names)(*[p(env) for p in parts])

        return do
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    c = _value(node[3])
    return lambda env: b(env) if a(env) else c(env)


def _expression(text: str) -> tuple:
    return fold(_Expression(text).whole())


def _tags(template: str, blocks: bool) -> Iterator[tuple[str, str]]:
    """``(kind, body)`` of literal text (kind ''), ``{{`` and ``{%`` tags; ends are looked for outside of strings and braces."""
    at, trim = 0, ""
    while True:
        starts = [k for k in (template.find(x, at) for x in ("{{", "{%", "{#")) if k >= 0]
        start = min(starts, default=len(template))
        text = template[at:start]
        text = text.lstrip() if trim == "-" else text[1:] if trim == "\n" and text[:1] == "\n" else text
        kind = template[start : start + 2]
        if template[start + 2 : start + 3] == "-":
            text = text.rstrip()
        elif blocks and kind in ("{%", "{#"):
            bare = text.rstrip(" \t")
            text = bare if not bare or bare.endswith("\n") else text
        if text:
            yield "", text
        if start == len(template):
            return
        end, depth, i = {"{{": "}}", "{%": "%}", "{#": "#}"}[kind], 0, start + 2
        while not (depth == 0 and template.startswith(end, i)):
            c = template[i : i + 1]
            if not c:
                raise TemplateError(f"{kind!r} has no end")
            if kind != "{#" and c in "'\"":
                i += 1
                while template[i : i + 1] not in (c, ""):
                    i += 1 + (template[i] == "\\")
            elif kind != "{#":
                depth += (c == "{") - (c == "}")
            i += 1
        body, at = template[start + 2 : i], i + 2
        trim = "-" if body.endswith("-") else "\n" if blocks and kind != "{{" else ""
        if kind != "{#":
            yield kind, body.removeprefix("-").removesuffix("-").strip()


def _targets(e: _Expression) -> list[str]:
    names = [e.name()]
    while e.accept(","):
        names.append(e.name())
    return names


def parse(template: str, blocks: bool = False) -> list[tuple]:
    """The syntax tree: ``('text', s) ('put', e) ('if', e, body, other) ('for', names, e, condition, body, other) ('set', names, e)
    ('field', name, key, e) ('capture', name, body) ('macro', name, names, defaults, body) ('mark', body) ('break',) ('continue',)``."""
    stack: list[tuple[str, list]] = [("", [])]
    heads: list[Any] = []
    for kind, body in _tags(template, blocks):
        if not kind:
            stack[-1][1].append(("text", body))
            continue
        if kind == "{{":
            stack[-1][1].append(("put", _expression(body)))
            continue
        word, rest = (*body.split(None, 1), "", "")[:2]
        bare = {"else", "endif", "endfor", "endset", "endmacro", "generation", "endgeneration", "break", "continue"}
        if word in bare and rest:
            raise TemplateError(f"unexpected {rest!r} after {word}")
        inside = [s[0] for s in stack]
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            if e.accept("."):
                key = e.name()
                e.expect("=")
                stack[-1][1].append(("field", name, key, fold(e.whole())))
            elif e.i == len(e.tokens):
                stack.append(("capture", [])), heads.append(name)
            else:
                e.i = 0
                names = _targets(e)
                e.expect("=")
                stack[-1][1].append(("set", names, fold(e.whole())))
        elif word == "endset" and inside[-1] == "capture":
            own = stack.pop()[1]
            stack[-1][1].append(("capture", heads.pop(), own))
        elif word == "macro":
            e = _Expression(rest)
            name, names, defaults = e.name(), [], []
            e.expect("(")
            while not e.accept(")"):
                names.append(e.name())
                if e.accept("="):
                    defaults.append(fold(e.choice()))
                elif defaults:
                    raise TemplateError("an argument without a default after one with")
                if not e.accept(",") and not e.peek(")"):
                    raise TemplateError("')' is missing")
            if e.i < len(e.tokens):
                raise TemplateError(f"unexpected text after the arguments of {name!r}")
            stack.append(("macro", [])), heads.append((name, names, defaults))
        elif word == "endmacro" and inside[-1] == "macro":
            own = stack.pop()[1]
            stack[-1][1].append(("macro", *heads.pop(), own))
        elif word == "if":
            stack.append(("if", [])), heads.append([(_expression(rest), stack[-1][1])])
        elif word in ("elif", "else") and inside[-1] == "if":
            own = []
            stack[-1] = ("if" if word == "elif" else "if else", own)
            heads[-1].append((_expression(rest) if word == "elif" else ("const", True), own))
        elif word == "endif" and inside[-1] in ("if", "if else"):
            stack.pop()
            node: list = []
            for test, own in reversed(heads.pop()):
                node = node if test[0] == "const" and not test[1] else own if test[0] == "const" else [("if", test, own, node)]
            stack[-1][1].extend(node)
        elif word == "for":
            e = _Expression(rest)
            names = _targets(e)
            e.expect("in")
            over = fold(e.either())
            only = fold(e.choice()) if e.accept("if") else None
            if e.i < len(e.tokens):
                raise TemplateError(f"unexpected {e.tokens[e.i][1]!r} in {rest!r}")
            stack.append(("for", [])), heads.append((names, over, only, stack[-1][1], []))
        elif word == "else" and inside[-1] == "for":
            stack[-1] = ("for else", heads[-1][4])
        elif word == "endfor" and inside[-1] in ("for", "for else"):
            stack.pop()
            stack[-1][1].append(("for", *heads.pop()))
        elif word in ("break", "continue") and "for" in inside[len(inside) - 1 - inside[::-1].index("macro") if "macro" in inside else 0 :]:
            stack[-1][1].append((word,))
        elif word == "generation":
            stack.append(("mark", [])), heads.append(None)
        elif word == "endgeneration" and inside[-1] == "mark":
            heads.pop()
            own = stack.pop()[1]
            stack[-1][1].append(("mark", own))
        else:
            raise TemplateError(f"unexpected tag {body!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} has no end")
    return stack[0][1]


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class _Macro:
    def __init__(self, name: str, names: list[str], defaults: list[Callable], body: Callable, env: dict) -> None:
        self.name, self.names, self.defaults, self.body, self.env = name, names, defaults, body, env

    def __call__(self, *args: Any, **named: Any) -> str:
        if len(args) > len(self.names) or set(named) - set(self.names[len(args) :]):
            raise TemplateError(f"{self.name!r} has other arguments")
        own, out = dict(self.env), _Out()
        first = len(self.names) - len(self.defaults)
        for k, name in enumerate(self.names):
            own[name] = args[k] if k < len(args) else named[name] if name in named else self.defaults[k - first](self.env) if k >= first else UNDEFINED
        self.body(own, out)
        return "".join(out.parts)


def _assign(env: dict, names: list[str], value: Any) -> None:
    if len(names) == 1:
        env[names[0]] = value
        return
    value = list(value)
    if len(value) != len(names):
        raise TemplateError(f"{len(value)} values for {len(names)} names")
    env.update(zip(names, value))


class _Out:
    __slots__ = ("parts", "size", "marks")

    def __init__(self) -> None:
        self.parts, self.size, self.marks = [], 0, []

    def put(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)


def _merged(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "put" and node[1][0] == "const":
            node = ("text", _text(node[1][1]))
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


def _block(nodes: list[tuple]) -> Callable[[dict, _Out], None]:
    steps = [_step(n) for n in _merged(nodes)]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: _Out) -> None:
        for s in steps:
            s(env, out)

    return run


def _step(node: tuple) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "text":
        s = node[1]
        return lambda env, out: out.put(s)
    if kind == "put":
        value = _value(node[1])

        def put(env: dict, out: _Out) -> None:
            v = value(env)
            out.put(v if isinstance(v, str) else _text(v))

        return put
    if kind == "set":
        names, value = node[1], _value(node[2])

        def assign(env: dict, out: _Out) -> None:
            _assign(env, names, value(env))

        return assign
    if kind == "field":
        name, key, value = node[1], node[2], _value(node[3])

        def change(env: dict, out: _Out) -> None:
            if not isinstance(env.get(name), _Namespace):
                raise TemplateError(f"{name!r} is no namespace")
            env[name][key] = value(env)

        return change
    if kind == "capture":
        name, body = node[1], _block(node[2])

        def capture(env: dict, out: _Out) -> None:
            own = _Out()
            body(env, own)
            env[name] = "".join(own.parts)

        return capture
    if kind == "macro":
        name, names, defaults, body = node[1], node[2], [_value(d) for d in node[3]], _block(node[4])

        def define(env: dict, out: _Out) -> None:
            env[name] = _Macro(name, names, defaults, body, env)

        return define
    if kind in ("break", "continue"):
        signal = _Break if kind == "break" else _Continue

        def leave(env: dict, out: _Out) -> None:
            raise signal

        return leave
    if kind == "if":
        test, yes, no = _value(node[1]), _block(node[2]), _block(node[3])
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    if kind == "mark":
        body = _block(node[1])

        def mark(env: dict, out: _Out) -> None:
            start = out.size
            body(env, out)
            out.marks.append((start, out.size))

        return mark
    names, value, only, body, other = node[1], _value(node[2]), node[3] and _value(node[3]), _block(node[4]), _block(node[5])

    def loop(env: dict, out: _Out) -> None:
        items = value(env)
        if not isinstance(items, (list, tuple, str, Mapping, _Undefined)):
            raise TemplateError(f"{type(items).__name__} can't be looped over")
        items = list(items)
        if only:
            kept = []
            for item in items:
                own = dict(env)
                _assign(own, names, item)
                if only(own):
                    kept.append(item)
            items = kept
        if not items:
            other(env, out)
        n = len(items)
        for k, item in enumerate(items):
            own = dict(env)  # what is set in a round is gone in the next
            _assign(own, names, item)
            own["loop"] = _Loop(
                index=k + 1, index0=k, revindex=n - k, revindex0=n - k - 1, first=k == 0, last=k == n - 1, length=n,
                previtem=items[k - 1] if k else UNDEFINED, nextitem=items[k + 1] if k + 1 < n else UNDEFINED,
            )
            try:
                body(own, out)
            except _Continue:
                continue
            except _Break:
                break

    return loop


def compile_template(template: str, blocks: bool = False) -> Callable[[Mapping[str, Any]], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the text and the marked spans, in characters."""
    body = _block(parse(template, blocks))

    def render(variables: Mapping[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        body(dict(variables), out)
        return "".join(out.parts), out.marks

    return render


def rendered(turns: DataFrame, template: str = CHATML, variables: Mapping[str, Any] | None = None, blocks: bool = False) -> DataFrame:
    """``(conv_id, text, n_turns, spans)``; ``spans`` lists the marked ``start-stop``, comma-separated."""
    compile_template(template, blocks)  # errors show here
    given = dict(variables or {})
    cols = [F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content")]
    lone = F.when(F.col("conv_id").cast("long").isNull(), F.monotonically_increasing_id())
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), lone.alias("lone"), F.struct(*cols).alias("message"))
    grouped = own.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("message")).alias("messages")).select("conv_id", "messages")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template, blocks)
        for batch in batches:
            texts, sizes, spans = [], [], []
            for messages in batch.column(1):
                value = messages.as_py()
                text, marks = run({**given, "messages": value})
                texts.append(text), sizes.append(len(value)), spans.append(",".join(f"{a}-{b}" for a, b in marks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(spans, pa.string())], ["conv_id", "text", "n_turns", "spans"])

    return grouped.mapInArrow(render, "conv_id long, text string, n_turns int, spans string")


def oracle_sql() -> str:
    return """WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS content,
  CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations),
 p AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, content || '<|im_end|>' AS body, row_number() OVER w AS k FROM m
  WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, content)),
 q AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, lone ORDER BY k) - length(body) - 1 AS start FROM p)
SELECT conv_id, string_agg(head || body || chr(10), '' ORDER BY k) AS text, CAST(count(*) AS INTEGER) AS n_turns,
 coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS spans
FROM q GROUP BY conv_id, lone"""
