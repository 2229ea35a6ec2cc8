"""Query rewriting: runs of terms replaced by alternatives over windows of terms.

Every tiling of a run by spans is an alternative; the result is the factored
tree ``E(i) = OR over spans s at i of (alternatives(i, s) AND E(i + s))``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from siftline.plans.nodes import And, AndNot, AtLeast, Maybe, Node, Not, Or, Term, parse, simplify

@dataclass(frozen=True)
class Alternative:
    """A text that may stand for a window, with flags for its terms and how well it translates."""

    text: str
    flags: int = 0
    coefficient: float = 1.0


Alternatives = Callable[[tuple[str, ...]], "list[str | Alternative]"]
MAX_WINDOW = 16


@dataclass(frozen=True)
class Provenance:
    """Which slots of the run an alternative stands for, how well, and how many there are."""

    start: int
    stop: int
    text: str
    flags: int = 0
    coefficient: float = 1.0
    source_size: int = 1


def from_rules(rules: Mapping[tuple[str, ...], list[str | Alternative]]) -> Alternatives:
    return lambda window: rules.get(window, [])


def rewrite(node: Node, alternatives: Alternatives, window: int = 3, budget: int | None = None, trace: list[Provenance] | None = None) -> Node:
    """``node`` with each run of terms under an ``And`` (or a lone term) expanded, until ``budget`` alternatives were added."""
    if not 0 < window < MAX_WINDOW:
        raise ValueError(f"windows have 1 to {MAX_WINDOW - 1} terms")
    left = [float("inf") if budget is None else budget]

    def expand(run: list[str]) -> Node:
        made: dict[int, Node | None] = {len(run): None}
        for i in range(len(run) - 1, -1, -1):
            options: list[Node] = []
            for span in range(min(window, len(run) - i), 0, -1):
                own: list[Node] = [Term(run[i])] if span == 1 else []
                for given in alternatives(tuple(run[i : i + span])):
                    if left[0] <= 0:
                        break
                    made_of = Alternative(given) if isinstance(given, str) else given
                    alt = parse(made_of.text)
                    if alt not in own:
                        own.append(alt)
                        left[0] -= 1
                        if trace is not None:
                            trace.append(Provenance(i, i + span, made_of.text, made_of.flags, made_of.coefficient, span))
                if own:
                    here = own[0] if len(own) == 1 else Or(tuple(own))
                    rest = made[i + span]
                    options.append(here if rest is None else And((here, rest)))
            made[i] = options[0] if len(options) == 1 else Or(tuple(options))
        return made[0]

    def visit(n: Node) -> Node:
        if isinstance(n, Term):
            return expand([n.text])
        if isinstance(n, And):
            out, run = [], []
            for p in [*n.parts, None]:
                if isinstance(p, Term):
                    run.append(p.text)
                    continue
                if run:
                    out.append(expand(run))
                    run = []
                if p is not None:
                    out.append(visit(p))
            return And(tuple(out))
        if isinstance(n, Or):
            return Or(tuple(map(visit, n.parts)))
        if isinstance(n, AtLeast):
            return AtLeast(n.least, tuple(map(visit, n.parts)))
        if isinstance(n, Maybe):
            return Maybe(visit(n.part))
        if isinstance(n, AndNot):
            return AndNot(visit(n.keep), visit(n.drop))
        return Not(visit(n.part)) if isinstance(n, Not) else n

    return simplify(visit(node))
