"""Regular expressions to one combined, minimised byte automaton.

``compile_rules`` parses each rule, builds one nondeterministic automaton for
the heads of all, makes it deterministic by subset construction, minimises it
by partition refinement and lays it out as one flat transition array over byte
classes.

A head is what a match begins with, up to the first repeat of more than one.
The repeats stay out of the common automaton because tokens that may hold
hyphens can begin again inside themselves, so that the subsets would have to
count each of many places; they are read on by an anchored automaton of the
rule from where its head was found.

``scan`` is linear in the text: a reading that meets the state which an earlier
reading of the rule had at the same place takes over what that one found.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from dataclasses import dataclass

WORD = frozenset(b for b in range(128) if chr(b).isalnum() or b == 95)
DIGIT = frozenset(range(48, 58))
SPACE = frozenset(b" \t\n\r\f\v")
ANY = frozenset(range(256))
NOT_WORD = ANY - WORD
_SETS = {"d": DIGIT, "w": WORD, "s": SPACE, "D": ANY - DIGIT, "W": NOT_WORD, "S": ANY - SPACE}
_CONTROL = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a regular expression of ASCII literals, classes, groups,
    ``|``, ``* + ? {m,n}`` and ``\\b`` (of ASCII words) at its ends; bytes are matched as they are."""

    name: str
    pattern: str


class _Parser:
    """Recursive descent to ``('set', s) | ('cat', [..]) | ('alt', [..]) | ('rep', x, m, n)``."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"unexpected end of {self.p!r}")
        self.i += 1
        return c

    def alt(self) -> tuple:
        parts = [self.cat()]
        while self.peek() == "|":
            self.take()
            parts.append(self.cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def cat(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat())
        return ("cat", parts)

    def repeat(self) -> tuple:
        node = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.take()
            if c == "{":
                low = self.number()
                high = low
                if self.peek() == ",":
                    self.take()
                    high = None if self.peek() == "}" else self.number()
                if self.take() != "}" or (high is not None and high < low):
                    raise ValueError(f"bad repeat in {self.p!r}")
            else:
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            node = ("rep", node, low, high)
        return node

    def number(self) -> int:
        digits = ""
        while self.peek().isdigit():
            digits += self.take()
        return int(digits)

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self.alt()
            if self.take() != ")":
                raise ValueError(f"unbalanced group in {self.p!r}")
            return node
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", ANY - {10})
        if c == "\\":
            return ("set", self.escape())
        if c in "*+?{":
            raise ValueError(f"nothing to repeat in {self.p!r}")
        return self.literal(c)

    def literal(self, c: str) -> tuple:
        parts = [("set", frozenset([b])) for b in c.encode()]
        return parts[0] if len(parts) == 1 else ("cat", parts)

    def escape(self) -> frozenset:
        c = self.take()
        if c in _SETS:
            return _SETS[c]
        if c in _CONTROL:
            return frozenset([_CONTROL[c]])
        if c.isalnum():
            raise ValueError(f"escape \\{c} is not supported in {self.p!r}")
        return frozenset(c.encode())

    def char_class(self) -> frozenset:
        negated = self.peek() == "^"
        if negated:
            self.take()
        got: set[int] = set()
        first = True
        while self.peek() != "]" or first:
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else frozenset(c.encode())
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else frozenset(c.encode())
                if len(low) != 1 or len(high) != 1:
                    raise ValueError(f"bad range in {self.p!r}")
                got.update(range(min(low), min(high) + 1))
            else:
                got |= low
        self.take()
        return frozenset(ANY - got if negated else got)


def parse(pattern: str) -> tuple[bool, tuple, bool]:
    """Whether a word must begin at the left, the tree, and whether one must end at the right."""
    left = pattern.startswith("\\b")
    right = pattern.endswith("\\b") and not pattern.endswith("\\\\b")
    body = pattern[2 if left else 0 : -2 if right else None]
    parser = _Parser(body)
    tree = parser.alt()
    if parser.i != len(body):
        raise ValueError(f"unbalanced group in {pattern!r}")
    return left, tree, right


def _reversed(tree: tuple) -> tuple:
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    parts = [_reversed(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, start: int) -> int:
        """The state that is reached from ``start`` through ``tree``."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(part, begin)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _byte_classes(sets: list[frozenset]) -> tuple[bytes, list[int]]:
    """A class number for each byte, and a byte of each class."""
    mark: dict[int, list[int]] = defaultdict(list)
    for k, s in enumerate(set(sets)):
        for b in s:
            mark[b].append(k)
    number: dict[tuple, int] = {}
    table = bytes(number.setdefault(tuple(mark[b]), len(number)) for b in range(256))
    return table, [table.index(k) for k in range(len(number))]


def _minimal(moves: list[list[int]], labels: list[tuple]) -> tuple[list[int], int]:
    """The block of each state in the coarsest stable partition (Moore's refinement)."""
    number: dict = {}
    block = [number.setdefault(x, len(number)) for x in labels]
    while True:
        number = {}
        finer = [number.setdefault((block[s], *[block[t] for t in row]), len(number)) for s, row in enumerate(moves)]
        if len(number) == len(set(block)):
            return finer, len(number)
        block = finer


@dataclass(frozen=True)
class Automaton:
    """``table[state + classes[byte]]`` is the next state; states are multiples of
    ``width``.  From state ``hit`` on, ``accepts[state // width]`` names the rules
    that end; ``dead`` is the state without a way to accept, or -1."""

    table: list[int]
    classes: bytes
    width: int
    start: int
    hit: int
    dead: int
    accepts: dict[int, tuple[int, ...]]


def _deterministic(nfa: _Nfa, start: int, ends: dict[int, int]) -> Automaton:
    classes, samples = _byte_classes([s for row in nfa.moves for s, _ in row])
    first = nfa.closure(frozenset([start]))
    ids, order, moves = {first: 0}, [first], []
    for now in order:
        row = []
        for b in samples:
            to = nfa.closure(frozenset(t for x in now for s, t in nfa.moves[x] if b in s))
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        moves.append(row)
    labels = [tuple(sorted({ends[x] for x in now if x in ends})) for now in order]
    block, count = _minimal(moves, labels)
    label, rows = {}, {}
    for s, k in enumerate(block):
        label[k], rows[k] = labels[s], [block[t] for t in moves[s]]
    ranked = sorted(range(count), key=lambda k: bool(label[k]))
    place = {k: n for n, k in enumerate(ranked)}
    width = len(samples)
    quiet = sum(not label[k] for k in ranked)
    dead = next((place[k] * width for k in ranked if not label[k] and set(rows[k]) == {k}), -1)
    return Automaton(
        [place[t] * width for k in ranked for t in rows[k]], classes, width, place[block[0]] * width, quiet * width, dead,
        {place[k]: label[k] for k in ranked if label[k]},
    )


#: Readings longer than this leave their states behind for later ones to meet.
TRAIL = 64


@dataclass(frozen=True)
class Scanner:
    """``scan`` reads a text once for the heads of all rules, and on from each head for its rule."""

    rules: tuple[Rule, ...]
    forward: Automaton
    backward: tuple[Automaton, ...]  # of the reversed heads
    whole: tuple[Automaton, ...]
    left: tuple[bool, ...]
    right: tuple[bool, ...]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """All ``(rule, end of a head)`` in one pass over the bytes."""
        a = self.forward
        table, hit, state, found = a.table, a.hit, a.start, []
        # a line feed stands for the text's beginning
        for at, c in enumerate((b"\n" + data).translate(a.classes)):
            state = table[state + c]
            if state >= hit:
                found += [(rule, at) for rule in a.accepts[state // a.width]]
        return found

    def _heads(self, rule: int, data: bytes, end: int) -> list[int]:
        """All places from which the head of ``rule`` reaches ``end``."""
        a, at, out = self.backward[rule], end, []
        state = a.start
        while True:
            if state >= a.hit and (not self.left[rule] or at == 0 or data[at - 1] not in WORD):
                out.append(at)
            if at == 0 or state == a.dead:
                return out
            at -= 1
            state = a.table[state + a.classes[data[at]]]

    def _matches(self, rule: int, data: bytes, starts: list[int]) -> list[tuple[int, int, int]]:
        """Of ascending ``starts``, the leftmost-longest matches that don't overlap."""
        a, closes, n = self.whole[rule], self.right[rule], len(data)
        table, classes, hit, dead = a.table, a.classes, a.hit, a.dead
        out, floor = [], 0
        trails: list[tuple[int, array, int]] = []  # where a reading began, its states, its match's end
        for s in starts:
            if s < floor:
                continue
            trails = [t for t in trails if t[0] + len(t[1]) > s]
            state, best, trail = a.start, -1, array("i")
            for at in range(s, n):
                state = table[state + classes[data[at]]]
                if state == dead:
                    break
                trail.append(state)
                if state >= hit and (not closes or (data[at] in WORD) != (at + 1 < n and data[at + 1] in WORD)):
                    best = at + 1
                met = next((t for t in trails if t[0] <= at < t[0] + len(t[1]) and t[1][at - t[0]] == state), None) if trails else None
                if met:
                    best = met[2] if met[2] > at + 1 else best
                    break
            if len(trail) > TRAIL:
                trails.append((s, trail, best))
            if best > s:
                out.append((rule, s, best))
                floor = best
        return out

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(rule, start, end)``: for each rule its leftmost-longest matches that don't overlap."""
        by_rule: dict[int, set[int]] = defaultdict(set)
        for rule, end in self.ends(data):
            by_rule[rule].add(end)
        return [x for rule, ends in sorted(by_rule.items()) for x in self._matches(rule, data, sorted({s for e in ends for s in self._heads(rule, data, e)}))]


def _head(tree: tuple) -> tuple:
    """What every match of ``tree`` begins with, up to its first repeat of more than one."""
    if tree[0] == "rep" and tree[3] != 1:
        return _head(tree[1]) if tree[2] else ("cat", [])
    if tree[0] != "cat":
        return tree
    parts = []
    for part in tree[1]:
        parts.append(_head(part))
        if part[0] == "rep" and part[3] != 1:
            break
    return ("cat", parts)


def compile_rules(rules: list[Rule]) -> Scanner:
    nfa = _Nfa()
    start = nfa.state()
    nfa.moves[start].append((ANY, start))
    ends, backward, whole, left, right = {}, [], [], [], []
    for k, rule in enumerate(rules):
        begins, tree, closes = parse(rule.pattern)
        one = _Nfa()
        first = one.state()
        whole.append(_deterministic(one, first, {one.add(tree, first): k}))
        head = _head(tree)
        ends[nfa.add(head, nfa.add(("set", NOT_WORD if begins else ANY), start))] = k
        back = _Nfa()
        first = back.state()
        backward.append(_deterministic(back, first, {back.add(_reversed(head), first): k}))
        left.append(begins)
        right.append(closes)
    return Scanner(tuple(rules), _deterministic(nfa, start, ends), tuple(backward), tuple(whole), tuple(left), tuple(right))
