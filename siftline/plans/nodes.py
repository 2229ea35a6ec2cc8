"""The query tree, its parser and its simplifier; pure Python, no Spark."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Union


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    part: Node


@dataclass(frozen=True)
class AndNot:
    keep: Node
    drop: Node


@dataclass(frozen=True)
class Maybe:
    """Optional: adds terms and score to its neighbours in an ``And``, never filters."""

    part: Node


@dataclass(frozen=True)
class AtLeast:
    least: int
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Leaf:
    """A named set of documents of the application's own."""

    name: str


Tokenizer = Callable[[str], "list[str]"]
Node = Union[Term, Phrase, And, Or, Not, AndNot, Maybe, AtLeast, Const, Leaf]
TRUE, FALSE = Const(True), Const(False)
MAX_PHRASE, MAX_TOKENS = 16, 8192
_WORD = re.compile(r"[^\W_]+")
_LEX = re.compile(r"\s*(\"[^\"]*\"|[()<>|,+]|-(?=\S)|[^\s()<>|,\"]+)")


class QueryError(ValueError):
    pass


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def leaf_of(text: str, tokenize: Tokenizer = words) -> Node | None:
    """A term, or a phrase where the tokenizer splits the word; nothing for signs without a word."""
    if re.fullmatch(r"\w+:\S+", text):
        return Term(text)
    parts = tokenize(text)
    if len(parts) > MAX_PHRASE:
        raise QueryError(f"a phrase has at most {MAX_PHRASE} words")
    return None if not parts else Term(parts[0]) if len(parts) == 1 else Phrase(tuple(parts))


class _Parser:
    """``or := and ((OR | '|') and)*``, ``and := item ((NOT | '-') item | AND? item)*``; ``NOT`` binds to its left side's items.

    Signs without a word, such as ``&``, are passed over.
    """

    def __init__(self, text: str, tokenize: Tokenizer = words) -> None:
        self.t, self.i, self.tokenize = [m for m in _LEX.findall(text)], 0, tokenize
        if len(self.t) > MAX_TOKENS:
            raise QueryError(f"a query has at most {MAX_TOKENS} tokens")

    def peek(self) -> str:
        return self.t[self.i] if self.i < len(self.t) else ""

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1] if self.i <= len(self.t) else ""

    def any(self) -> Node | None:
        parts = [self.all()]
        while self.peek() in ("OR", "|"):
            self.take()
            parts.append(self.all())
        parts = [p for p in parts if p is not None]
        return None if not parts else parts[0] if len(parts) == 1 else Or(tuple(parts))

    def all(self) -> Node | None:
        parts: list[Node] = []
        dropped: list[Node] = []
        start = self.i
        while (t := self.peek()) and t not in (")", ">", "|", "OR", ","):
            if t in ("AND", "+"):
                self.take()
            else:
                to = dropped if t in ("NOT", "-") else parts
                if to is dropped:
                    self.take()
                made = self.item()
                if made is not None:
                    to.append(made)
        if self.i == start:
            raise QueryError("an operand is missing")
        node = None if not parts else parts[0] if len(parts) == 1 else And(tuple(parts))
        for d in dropped:
            node = Not(d) if node is None else AndNot(node, d)
        return node

    def item(self) -> Node | None:
        t = self.take()
        if t in ("(", "<"):
            node = self.any()
            if self.take() != {"(": ")", "<": ">"}[t]:
                raise QueryError(f"{t!r} has no end")
            return node if t == "(" or node is None else Maybe(node)
        if t == "MINMATCH" and self.peek() == "(":
            self.take()
            least, parts = self.take(), []
            if not least.isdigit():
                raise QueryError(f"MINMATCH needs a number, not {least!r}")
            while self.peek() == ",":
                self.take()
                parts.append(self.any() or FALSE)
            if self.take() != ")":
                raise QueryError("MINMATCH has no end")
            return AtLeast(int(least), tuple(parts))
        if t in ("", ")", ">", "|", "OR", "AND", "NOT", "-", ","):
            raise QueryError(f"unexpected {t!r}")
        return leaf_of(t.strip('"'), self.tokenize)


def parse(text: str, tokenize: Tokenizer = words) -> Node:
    """The tree of a query; ``tokenize`` turns its words into terms as the index's tokenizer did. A query without a word matches nothing."""
    p = _Parser(text, tokenize)
    if not p.t:
        return FALSE
    node = p.any()
    if p.i < len(p.t):
        raise QueryError(f"unexpected {p.peek()!r}")
    return FALSE if node is None else node


def children(node: Node) -> tuple[Node, ...]:
    if isinstance(node, (And, Or, AtLeast)):
        return node.parts
    if isinstance(node, (Not, Maybe)):
        return (node.part,)
    return (node.keep, node.drop) if isinstance(node, AndNot) else ()


def walk(node: Node, positive: bool = False) -> Iterator[Node]:
    """All nodes; with ``positive`` none that only excludes."""
    yield node
    for k, part in enumerate(children(node)):
        if positive and (isinstance(node, Not) or (isinstance(node, AndNot) and k)):
            continue
        yield from walk(part, positive)


def leaves(node: Node, positive: bool = False) -> list[Node]:
    return list(dict.fromkeys(n for n in walk(node, positive) if isinstance(n, (Term, Phrase, Leaf))))


def terms_of(node: Node, positive: bool = False) -> list[str]:
    out: dict[str, None] = {}
    for n in leaves(node, positive):
        out.update(dict.fromkeys([n.text] if isinstance(n, Term) else n.terms if isinstance(n, Phrase) else ()))
    return list(out)


def _once(parts: list[Node]) -> list[Node]:
    return list(dict.fromkeys(parts))


def simplify(node: Node) -> Node:
    """An equivalent tree: constants folded, chains flattened, repeats, contradictions, trivial thresholds and what a part of it already implies removed.

    An optional part is left only beside needed parts of an ``And``; elsewhere it is what it holds.
    """
    while (now := _simpler(node)) != node:
        node = now
    return node


def inside(part: tuple[str, ...], whole: tuple[str, ...]) -> bool:
    """Whether the words of ``part`` stand side by side in ``whole``."""
    return any(whole[k : k + len(part)] == part for k in range(len(whole) - len(part) + 1))


def implies(a: Node, b: Node) -> bool:
    """Whether every document of ``a`` surely is one of ``b``: a phrase has its terms and its inner phrases."""
    if a == b or b == TRUE or a == FALSE:
        return True
    if isinstance(a, Phrase):
        return (isinstance(b, Term) and b.text in a.terms) or (isinstance(b, Phrase) and inside(b.terms, a.terms)) or (isinstance(b, Or) and any(implies(a, p) for p in b.parts))
    if isinstance(b, Or):
        return any(implies(a, p) for p in b.parts)
    if isinstance(a, And):
        return any(implies(p, b) for p in a.parts if not isinstance(p, Maybe))
    return isinstance(a, AndNot) and implies(a.keep, b)


def _needed(parts: list[Node]) -> list[Node]:
    """Without the parts that another one implies by a phrase; other repeats stay, since they score."""
    return [p for k, p in enumerate(parts) if not any(n != k and isinstance(q, Phrase) and isinstance(p, Phrase) and implies(q, p) for n, q in enumerate(parts))]


def _simpler(node: Node) -> Node:
    if isinstance(node, Phrase):
        return Term(node.terms[0]) if len(node.terms) == 1 else node
    if isinstance(node, Maybe):
        return _simpler(node.part)
    if isinstance(node, And):
        needed: list[Node] = []
        optional: list[Node] = []
        for part in node.parts:
            p = _simpler(part)
            if isinstance(part, Maybe):
                optional.append(p)
            elif isinstance(p, And):
                needed += [q for q in p.parts if not isinstance(q, Maybe)]
                optional += [q.part for q in p.parts if isinstance(q, Maybe)]
            else:
                needed.append(p)
        if node.parts and not needed:  # nothing but optional parts: one of them has to be there
            return _simpler(Or(tuple(optional)))
        if FALSE in needed:
            return FALSE
        sure = TRUE in needed
        needed = _needed(_once([p for p in needed if p != TRUE]))
        for p in needed:
            dropped = [p.drop] if isinstance(p, AndNot) else [p.part] if isinstance(p, Not) else []
            if any(implies(q, d) for d in dropped for q in needed if q != p):
                return FALSE
        optional = _once([p for p in optional if not isinstance(p, Const)])
        if not needed and (sure or not node.parts):
            return TRUE if not optional else And((TRUE, *map(Maybe, optional)))
        parts = [*needed, *map(Maybe, optional)]
        return parts[0] if len(parts) == 1 else And(tuple(parts))
    if isinstance(node, Or):
        parts = []
        for p in map(_simpler, node.parts):
            parts += p.parts if isinstance(p, Or) else [p]
        parts = _once([p for p in parts if p != FALSE])
        if TRUE in parts:
            return TRUE
        return FALSE if not parts else parts[0] if len(parts) == 1 else Or(tuple(parts))
    if isinstance(node, Not):
        p = _simpler(node.part)
        return Const(not p.value) if isinstance(p, Const) else p.part if isinstance(p, Not) else Not(p)
    if isinstance(node, AndNot):
        keep, drop = _simpler(node.keep), _simpler(node.drop)
        if keep == FALSE or drop == TRUE or implies(keep, drop):
            return FALSE
        if isinstance(keep, Or):  # alternatives that are excluded anyway
            rest = tuple(p for p in keep.parts if not implies(p, drop))
            keep = FALSE if not rest else rest[0] if len(rest) == 1 else Or(rest)
        if keep == TRUE:
            return Not(drop)
        return keep if drop == FALSE or keep == FALSE else AndNot(keep, drop)
    if isinstance(node, AtLeast):
        parts = [_simpler(p) for p in node.parts]
        least = node.least - sum(p == TRUE for p in parts)
        parts = [p for p in parts if not isinstance(p, Const)]
        if least > len(parts):
            return FALSE
        if least <= 0:
            return TRUE
        if least == len(parts):
            return And(tuple(parts)) if least > 1 else parts[0]
        return Or(tuple(parts)) if least == 1 else AtLeast(least, tuple(parts))
    return node


def settled(node: Node) -> Node:
    """The tree that percolation judges: an optional alternative of an ``Or`` is an alternative, any other optional part is true."""
    if isinstance(node, Maybe):
        return TRUE
    if isinstance(node, Or):
        parts = []
        for p in node.parts:
            while isinstance(p, Maybe):
                p = p.part
            parts.append(settled(p))
        return Or(tuple(parts))
    if isinstance(node, And):
        return And(tuple(map(settled, node.parts)))
    if isinstance(node, AtLeast):
        return AtLeast(node.least, tuple(map(settled, node.parts)))
    if isinstance(node, Not):
        return Not(settled(node.part))
    return AndNot(settled(node.keep), settled(node.drop)) if isinstance(node, AndNot) else node


def matches(node: Node, toks: list[str], percolating: bool = False) -> bool:
    """Whether a document of these tokens matches; the plain definition that plans are tested against."""
    if percolating:
        return matches(settled(node), toks)
    has = lambda n: matches(n, toks)
    if isinstance(node, Const):
        return node.value
    if isinstance(node, Term):
        return node.text in toks
    if isinstance(node, Phrase):
        return inside(node.terms, tuple(toks))
    if isinstance(node, And):
        needed = [p for p in node.parts if not isinstance(p, Maybe)]
        return any(map(has, node.parts)) if node.parts and not needed else all(map(has, needed))
    if isinstance(node, Or):
        return any(map(has, node.parts))
    if isinstance(node, Not):
        return not has(node.part)
    if isinstance(node, AndNot):
        return has(node.keep) and not has(node.drop)
    if isinstance(node, Maybe):
        return has(node.part)
    if isinstance(node, AtLeast):
        return sum(map(has, node.parts)) >= node.least
    raise QueryError(f"{node} needs documents")
