"""Personal data by candidate gradient boosting.

1. High-recall generators propose overlapping spans from every place where one
   may begin: e-mail addresses (with each end their host may have), phone
   numbers in international, national and pairwise groups, card numbers,
   network addresses of both versions, national numbers, accounts, and names
   and street addresses by what is around them.  No span has a greatest length.
2. Each span gets features of its format (digits, groups, separators, check
   digits, octets) and of its context (neighbouring characters, words before).
3. Boosted trees, trained on the driver on made-up sentences (``_examples``),
   give a margin; a logistic curve fitted on sentences of another maker
   (``_others``: other formats, words and surroundings) makes it a probability,
   and each kind has the least threshold that keeps precision there at
   ``PRECISION``; a kind for which no threshold does is not redacted.
4. Of overlapping spans above their thresholds the most probable is redacted.

The model has a fixed size and is made once a process; texts are read in place
and nothing is shuffled.

Cases: null and empty texts have no spans; texts of any length are used whole;
repeated rows are redacted each; a null id stays null; other columns, whatever
their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 0.99
KINDS = ("email", "phone", "card", "ip", "national_id", "account", "name", "address")
_RUN = re.compile(r"[+(]?\d(?:[\d ().\-/]*\d)?")
_LOCAL = frozenset(".%+-_'")
_HOST = re.compile(r"[\w\-]+(?:\.[\w\-]+)+")
_BEGIN = r"(?<![\d])"
#: Within runs of digits; each is tried from every digit, sign or parenthesis that no digit precedes.
_IN_RUN: list[tuple[int, re.Pattern]] = [
    (KINDS.index(kind), re.compile(_BEGIN + pattern + r"(?!\d)"))
    for kind, pattern in (
        ("phone", r"(?:(?:\+|00)\d{1,3}[ .\-]?)?\(\d{1,5}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}"), ("phone", r"(?:(?:\+|00)\d{1,3}[ .\-])\d{1,4}(?:[ .\-]\d{2,4}){1,5}"), ("phone", r"\+\d{8,15}"), ("phone", r"0?\d{9,11}"),
        ("phone", r"\d{2,5}[ .\-/]\d{3,4}(?:[ .\-]\d{3,4}){0,2}"), ("phone", r"\d{2}(?:[ .\-]\d{2}){3,4}"), ("phone", r"\d{3,5}[ .\-/]\d{5,8}"),
        ("card", r"\d{13,19}"), ("card", r"\d{4}(?:[ \-]\d{4}){3}"), ("card", r"\d{4}[ \-]\d{6}[ \-]\d{5}"), ("ip", r"\d{1,3}(?:\.\d{1,3}){3}"), ("national_id", r"\d{3}-\d{2}-\d{4}"), ("national_id", r"\d{3} \d{2} \d{4}"),
    )
]
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?[A-Z0-9]{4}){2,6}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_NINO = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![A-Za-z0-9])")
_PERSON = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\b\.?|\b[Nn]ame(?: is|:)|\b[Ii] am|\b[Dd]ear|\b[Ss]igned(?: by)?:?|\b[Pp]atient:?|\b[Cc]ontact:?) +(?=([A-Z][\w'\-]+(?: [A-Z][\w'\-]+)*))")
_STREET = re.compile(r"(?<![\w.,\-])\d+[A-Za-z]?(?: [A-Z][\w'\-]+)+ (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Terrace)\b|\b[A-Z][\w\-]*(?:straße|strasse|weg|gasse|allee) \d+[a-z]?\b|\b(?:rue|Rue|calle|Calle|avenue|Avenida)(?: de| la| del| des| du)* [A-Z][\w\-]+,? \d+\b|\b\d+,? (?:rue|avenue|boulevard)(?: de| la| des| du)* [A-Z][\w\-]+")
_HINT = re.compile(r"[@0-9]|::|[a-fA-F]:")
_FOR = [
    re.compile(p, re.I)
    for p in (r"mail|contact|write|correo", r"phone|tel|call|mobile|fax|cell|dial", r"card|visa|credit|pay", r"\bip\b|host|login|address|server", r"ssn|social|tax|passport", r"iban|account|bank|konto",
              r"order|invoice|ref|serial|sku|isbn|ticket|item|model|part", r"version|release|build|v$|section|chapter|figure|table", r"sha|hash|commit|uuid|hex|token|checksum|[\"'=#]$", r"[$€£]\s*$|price|total|sum|date|year|page")
]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(text: str) -> bool:
    own = text.replace(" ", "")
    return 15 <= len(own) <= 34 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
            start -= 1
        host = _HOST.match(text, at + 1)
        if start < at and host:
            starts = {start}
            while start < at and text[start] in _LOCAL:  # 'name: -a@b.c' and the like
                start += 1
            starts.add(start)
            stop, stops = at + 1, []
            for label in host[0].split("."):
                stop += len(label)
                stops.append(stop)
                stop += 1
            for end in stops[1:]:
                for begin in starts:
                    if begin < at:
                        yield begin, end
        at = text.find("@", at + 1)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """``(start, stop, kind)``, overlaps included."""
    if not text:
        return []
    out = {(m.start(1), m.end(1), 6) for m in _PERSON.finditer(text)} if text.isascii() or " " in text else set()
    if not _HINT.search(text):
        return sorted(out)
    out |= {(a, b, 0) for a, b in _emails(text)}
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a < 6:
            continue
        # one digit beyond the run on either side is seen by the looks around it
        for at in range(a, b):
            c = text[at]
            if (c in "+(" or c.isdigit()) and not (at and text[at - 1].isdigit()):
                for kind, pattern in _IN_RUN:
                    if m := pattern.match(text, at, b):
                        out.add((at, m.end(), kind))
    for kind, pattern in ((5, _ACCOUNT), (3, _IP6), (4, _NINO), (7, _STREET)):
        out |= {(*m.span(), kind) for m in pattern.finditer(text)}
    return sorted(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _near(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3 if c in ".,;:!?)]" else 4


def _address(span: str) -> bool:
    try:
        ipaddress.ip_address(span)
    except ValueError:
        return False
    return True


def features(text: str, start: int, stop: int, kind: int) -> list[float]:
    span, before = text[start:stop], text[max(0, start - 32) : start]
    digits = re.sub(r"[^0-9]", "", span)
    parts = re.split(r"[ .\-()+/]+", span.strip("+( "))
    groups = [len(p) for p in parts if p]
    prev, after = text[start - 1 : start] if start else "", text[stop : stop + 1]
    beyond = text[stop + 1 : stop + 2]
    joined = after in (".", "-", "/", "_", ":", "@") and beyond.isalnum()
    led = prev in (".", "-", "/", "_", ":", "@") and start > 1 and text[start - 2].isalnum()
    # whether the digits go on beyond one blank, as in rows of numbers
    more = after == " " and beyond.isdigit()
    less = prev == " " and start > 1 and text[start - 2].isdigit()
    host = span.rpartition("@")[2] if kind == 0 else ""
    top = host.rpartition(".")[2]
    return [
        kind, len(digits), len(span), len(digits) > 11 and luhn(digits), kind == 3 and _address(span), kind == 5 and iban(span), span.startswith("+"), "(" in span, span.count("."), span.count("-"), span.count(" "),
        len(groups), max(groups, default=0), min(groups, default=0), len(set(digits)), int(digits[:1] or 0), _near(prev), _near(after), joined, led, more, less, groups[:1] == [3], groups == [4, 4, 4, 4], "/" in span,
        len(span) - len(host), len(top) if top.isalpha() else 0, ".." in span, bool(span) and span[0] in ".-+_%'", prev == "." or after == ":", span.count(":"), *[bool(p.search(before)) for p in _FOR],
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: split features and thresholds level by level, then leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 150, depth: int = 4, rate: float = 0.2) -> Trees:
    """Second-order boosting of the logistic loss, level by level, split at the values' quantiles."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 17)))[:-1] for c in x.T]
    column = np.repeat(np.arange(x.shape[1]), [len(c) for c in cuts])
    value = np.concatenate(cuts)
    above = (x[:, column] > value[None, :]).astype(np.float32)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(x), base)
    inner, fs, ts, leaves = 2**depth - 1, [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = (y - p).astype(np.float32), (p * (1 - p)).astype(np.float32)
        f, t, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            own = np.zeros((2 * size, len(x)), dtype=np.float32)
            own[node - first, np.arange(len(x))], own[size + node - first, np.arange(len(x))] = g, h
            sums, right = own.sum(axis=1, dtype=np.float64), (own @ above).astype(np.float64)
            gs, hs, gr, hr = sums[:size, None], sums[size:, None], right[:size], right[size:]
            gain = gr**2 / (hr + 1) + (gs - gr) ** 2 / (hs - hr + 1) - gs**2 / (hs + 1)
            for k, best in enumerate(gain.argmax(axis=1)):
                if gain[k, best] > 1e-6:
                    f[first + k], t[first + k] = column[best], value[best]
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
        leaf = node - inner
        step = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += step[leaf]
        fs.append(f), ts.append(t), leaves.append(step)
    return Trees(np.array(fs), np.array(ts), np.array(leaves), base)


def _card(r: random.Random, heads: str = "3456", size: int = 16) -> str:
    own = r.choice(heads) + "".join(r.choice("0123456789") for _ in range(size - 2))
    return own + next(c for c in "0123456789" if luhn(own + c))


def _unlucky(digits: str) -> str:
    """Digits that are no card's."""
    return digits[:-1] + str((int(digits[-1]) + 1) % 10) if luhn(digits) else digits


def _iban(r: random.Random, spaced: bool, wrong: int = 0) -> str:
    body, land = "".join(r.choice("0123456789") for _ in range(r.choice((14, 18, 20)))), r.choice(["DE", "FR", "GB", "ES", "IT", "NL"])
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    own = f"{land}{(check + wrong) % 98:02}{body}"
    return " ".join(own[k : k + 4] for k in range(0, len(own), 4)) if spaced else own


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[str, str]]]]:
    """Made-up sentences and the private spans of each, with their kinds."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    x = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrstdhm") for _ in range(r.randint(2, 9)))
    big = lambda: word().capitalize()
    octets = lambda: ".".join(str(r.randint(0 if k else 1, r.choice([3, 20, 255, 255, 255]))) for k in range(4))

    yes: dict[str, Callable[[], str]] = {
        "email": lambda: f"{word()}{r.choice(['', '.', '_', '-', '+'])}{r.choice([word(), d(2), '', word() * 9])}{word()}@{r.choice(['', 'mail' + d(1) + '.', word() + '.'])}{word()}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'io', 'co.uk', 'info'])}",
        "phone": lambda: r.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(6)}", f"+49 {d(3)} {d(7)}", f"0{d(2)}/{d(7)}"]),
        "card": lambda: r.choice([_card(r, "123456789"), _card(r), (c := _card(r))[:4] + " " + c[4:8] + " " + c[8:12] + " " + c[12:], (c := _card(r))[:4] + "-" + c[4:8] + "-" + c[8:12] + "-" + c[12:]]),
        "ip": lambda: r.choice([octets(), octets(), octets(), ":".join(x(4) for _ in range(8)), f"fe80::{x(4)}:{x(3)}", f"2001:db8::{x(2)}"]),
        "national_id": lambda: r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{r.choice('ABCEGH')}{r.choice('ABCEGH')} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{r.choice('ABCEGH')}{r.choice('ABCEGH')}{d(6)}{r.choice('ABCD')}"]),
        "account": lambda: _iban(r, r.random() < 0.6),
        "name": lambda: f"{big()} {big()}",
        "address": lambda: r.choice([f"{r.randint(1, 9999)} {big()} {r.choice(['Street', 'Avenue', 'Road', 'Lane', 'Drive', 'Blvd'])}", f"{big()}straße {r.randint(1, 200)}", f"rue de {big()} {d(2)}", f"{d(2)} rue {big()}"]),
    }
    no: list[Callable[[], str]] = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {d(2)}", lambda: f"{d(2)}.{d(2)}.{r.randint(1900, 2030)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(2)}/{d(2)}/{r.randint(1900, 2030)}", lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"version {r.randint(1, 20)}.{d(1)}.{d(2)}.{d(3)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}.{d(1)}", lambda: f"{r.randint(256, 999)}.{d(3)}.{r.randint(256, 999)}.{d(2)}", lambda: f"order {d(r.randint(6, 16))}", lambda: f"{d(3)} {d(4)}", lambda: f"{d(2)} {d(2)} {d(2)}",
        lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(7)}", lambda: f"{d(r.randint(8, 12))}", lambda: f"{d(3)},{d(3)}.{d(2)}", lambda: f"{r.randint(1, 9)} {d(3)} {d(3)} {d(3)}", lambda: f"pages {d(3)}-{d(3)}", lambda: " ".join(d(r.randint(2, 4)) for _ in range(r.randint(4, 12))),
        lambda: f"sha {x(40)}", lambda: f"id {d(8)}-{d(4)}-{d(4)}-{d(4)}-{d(12)}", lambda: f"{word()}@{word()}", lambda: f"part {d(4)}-{d(4)}", lambda: f"{d(5)} {d(5)} {d(5)}", lambda: f"{d(20)}", lambda: f"1.2.3.4.{d(2)}.{d(1)}", lambda: f"{word()}@2.{d(1)}.{d(1)}", lambda: f"{x(2)}:{x(2)}:{x(2)}:{x(2)}:{x(2)}:{x(2)}",
        lambda: " ".join(d(4) for _ in range(r.randint(5, 8))), lambda: _unlucky(d(16)), lambda: f"{r.choice(['order', 'serial', 'ref', 'ticket', 'sku', 'invoice'])} {_card(r, '123456789', r.randint(13, 19))}", lambda: f"{r.choice(['version', 'release', 'build'])} {octets()}", lambda: f"{octets()}.{d(2)}", lambda: f"{d(r.randint(9, 11))}", lambda: _iban(r, r.random() < 0.6, r.randint(1, 90)), lambda: _unlucky(_card(r)), lambda: " ".join(_unlucky(d(16))[k : k + 4] for k in (0, 4, 8, 12)), lambda: ".".join(f"{r.choice((256, 300, 999, 0, 7)):03}" for _ in range(4)), lambda: _unlucky(d(r.choice([13, 14, 15, 17, 18, 19]))), lambda: f"{r.choice(['DE', 'AB', 'XY'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(3)}", lambda: f"Dear {r.choice(['Sir', 'Madam', 'All', 'Customer'])}", lambda: f"Dr {big()}", lambda: f"std::{word()}", lambda: f"{d(4)} {big()}",
    ]
    lead = {"email": ["mail", "contact"], "phone": ["call", "phone", "tel."], "card": ["card", "visa"], "ip": ["from ip", "host"], "national_id": ["ssn"], "account": ["iban", "account"], "address": ["at", "lives at"]}
    out = []
    for _ in range(n):
        left, right = (" ".join(word() for _ in range(r.randint(1, 5))) for _ in "ab")
        if r.random() < 0.5:
            kind = r.choice(list(yes))
            span = yes[kind]()
            left += " " + r.choice(["Mr", "Mrs.", "my name is", "Name:", "Dear", "Patient:", "signed by"]) if kind == "name" else " " + r.choice(lead[kind]) if r.random() < 0.3 else ""
        else:
            span, kind = "", ""
        shown, spans = span or r.choice(no)(), [(kind, span)] if kind else []
        if r.random() < 0.15:  # two beside each other
            second = r.choice(["phone", "card", "ip", "email", "national_id"])
            spans.append((second, yes[second]()))
            right = spans[-1][1] + " " + right
        if spans[:1] and spans[0][0] == "name":
            shown = " " + shown + r.choice(["", ",", ".", " "])
        else:
            shown = r.choice([" {}", " {}", " {}", " {}", ", {}", ": {}", " ({})", ' "{}"', ">{}<", "[{}", " {};"]).format(shown) + r.choice(["", "", ".", ",", "###", "!!"])
        out.append((left + shown + " " + right, spans))
    return out


def _others(n: int, seed: int) -> list[tuple[str, list[tuple[str, str]]]]:
    """As ``_examples`` by another maker: real words, tables, logs, code and letters instead of sentences, and other formats."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = "the report was sent after lunch because our team wanted numbers from every office before winter and nobody objected".split()
    some = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 7)))
    first, last = ["Anna", "John", "Maria", "Peter", "Chloé", "José", "Liam"], ["Smith", "Müller", "Dubois", "García", "O'Neil", "Brown-Lee"]
    person = lambda: f"{r.choice(first)} {r.choice(last)}"
    yes = {
        "email": lambda: f"{r.choice(first).lower()}{r.choice(['.', '', '_'])}{r.choice(['smith', 'dubois', 'lee'])}{r.choice(['', d(2)])}@{r.choice(['example.com', 'mail3.example.com', 'uni-bonn.de', 'acme.co.uk', 'post.museum'])}",
        "phone": lambda: r.choice([f"+1 ({d(3)}) 555-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"({d(3)}) 555-{d(4)}", f"1-800-{d(3)}-{d(4)}"[2:], f"+49-30-{d(4)}-{d(4)}"]),
        "card": lambda: r.choice([_card(r, "45"), (c := _card(r, "45"))[:4] + " " + c[4:8] + " " + c[8:12] + " " + c[12:], _card(r, "23456789")]),
        "ip": lambda: r.choice([f"{r.randint(1, 223)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}", f"192.168.{r.randint(0, 255)}.{r.randint(1, 254)}", f"2001:db8:0:{d(1)}::{d(2)}"]),
        "national_id": lambda: f"{d(3)}-{d(2)}-{d(4)}", "account": lambda: _iban(r, r.random() < 0.5), "name": person,
        "address": lambda: r.choice([f"{r.randint(1, 999)} {r.choice(['Oak', 'King', 'Old Mill'])} {r.choice(['Street', 'Road', 'Ave', 'Lane'])}", f"{r.choice(['Haupt', 'Garten'])}straße {r.randint(1, 99)}"]),
    }
    no = [lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{d(2)}:{d(2)}:{d(2)}", lambda: f"${d(1)},{d(3)}.{d(2)}", lambda: f"build {d(2)}.{d(1)}.{d(4)}", lambda: f"{d(3)}x{d(3)}", lambda: f"ticket #{d(6)}", lambda: f"{d(1)}.{d(8)}", lambda: ",".join(d(3) for _ in range(6)), lambda: f"ISBN {d(13)}"[:16], lambda: f"lines {d(3)}-{d(3)}", lambda: f"@{r.choice(first)}", lambda: f"{d(2)}%", lambda: f"{r.randint(256, 400)}.{d(3)}.{d(2)}.{d(2)}", lambda: "|".join(d(2) for _ in range(8)), lambda: f"2{d(3)} {r.choice(['people', 'Roads', 'items'])}", lambda: f"serial {d(14)}", lambda: "Dear Customer", lambda: f"{d(2)}:{d(2)}", lambda: f"rev {d(5)}", lambda: f"pkg@{d(1)}.{d(2)}.{d(1)}", lambda: d(r.randint(8, 12)), lambda: " ".join(d(r.randint(1, 4)) for _ in range(r.randint(3, 9))), lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"invoice {_card(r, '45')}", lambda: f"version {r.randint(1, 9)}.{d(1)}.{d(2)}.{d(2)}", lambda: _unlucky(d(16))]
    frames = ["{}", "{}.", "<td>{}</td>", '"{}",', "[{}]", "{};", "({})", "{}!!"]
    out = []
    for _ in range(n):
        kind = r.choice(list(yes)) if r.random() < 0.5 else ""
        span = yes[kind]() if kind else ""
        lead = {"name": r.choice(["Mr.", "Dear", "name:", "Dr."]), "": ""}.get(kind, r.choice(["", "", f"{kind}:", "see"]))
        out.append((f"{some()} {lead} {span if kind == 'name' else r.choice(frames).format(span or r.choice(no)())} {some()}", [(kind, span)] if kind else []))
    return out


@dataclass(frozen=True)
class Model:
    trees: Trees
    slope: float
    shift: float
    thresholds: np.ndarray

    def spans(self, text: str) -> list[tuple[int, int, int, float]]:
        """``(start, stop, kind, probability)`` to redact, none overlapping, in order."""
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """``spans`` of each text; the trees judge all candidates together."""
        found = [candidates(t) if t else [] for t in texts]
        x = np.array([features(t, *c) for t, own in zip(texts, found) for c in own], dtype=float)
        if not len(x):
            return [[] for _ in texts]
        p = _sigmoid(self.slope * self.trees.margin(x) + self.shift)
        good = p >= self.thresholds[x[:, 0].astype(int)]
        out, at = [], 0
        for own in found:
            out.append(_best([(c, float(p[k])) for k, c in enumerate(own, at) if good[k]]))
            at += len(own)
        return out


def _best(good: list[tuple[tuple[int, int, int], float]]) -> list[tuple[int, int, int, float]]:
    """Of overlapping spans the most probable, then the longest."""
    taken: list[tuple[int, int, int, float]] = []
    starts: list[int] = []
    for q, _, a, b, k in sorted((-round(q, 6), a - b, a, b, k) for (a, b, k), q in good):
        at = bisect_left(starts, b)
        if not at or taken[at - 1][1] <= a:
            starts.insert(at, a)
            taken.insert(at, (a, b, k, -q))
    return taken


def _rows(sentences: list[tuple[str, list[tuple[str, str]]]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for text, spans in sentences:
        for a, b, k in candidates(text):
            x.append(features(text, a, b, k))
            y.append((KINDS[k], text[a:b]) in spans)
    return np.array(x, dtype=float), np.array(y, dtype=float)


@lru_cache(maxsize=2)
def train(n: int = 10_000, seed: int = 7) -> Model:
    """The model; made once a process."""
    trees = boost(*_rows(_examples(n, seed)))
    x, y = _rows(_others(n, seed + 1))
    m = trees.margin(x)
    design, w = np.column_stack([m, np.ones(len(m))]), np.array([0.5, 0.0])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))  # Platt's, so that the curve stays finite
    for _ in range(60):
        p = _sigmoid(design @ w)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (target - p))
        w = w + np.clip(step, -0.1, 0.1)
    p = _sigmoid(design @ w)
    return Model(trees, float(w[0]), float(w[1]), np.array([threshold(p[x[:, 0] == k], y[x[:, 0] == k]) for k in range(len(KINDS))]))


def threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION, spare: int = 2) -> float:
    """The least threshold that is right at least so often, with ``spare`` errors fewer than that allows; infinite for none.

    It lies midway, in log-odds, between the last true span that is kept and the next span below.
    """
    order = np.argsort(-p, kind="stable")
    q, right = p[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.zeros(0, dtype=np.int64)
    true = np.diff(right[ends], prepend=0) > 0
    good = ends[true & (right[ends] >= precision * (ends + 1) + spare * (right[ends] < ends + 1))]
    if not len(good):
        return float("inf")
    pair = np.clip(q[[good[-1], min(good[-1] + 1, len(q) - 1)]], 1e-9, 1 - 1e-9)
    return float(_sigmoid(np.log(pair / (1 - pair)).mean()))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_spans, kinds, least_probability)`` of the documents with personal data, each span as ``[KIND]``."""
    model = train()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], batch.column(1).to_pylist()
            for n, (text, spans) in enumerate(zip(texts, model.spans_of(texts))):
                if spans:
                    parts, at = [], 0
                    for a, b, k, _ in spans:
                        parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                        at = b
                    rows.append((n, "".join([*parts, text[at:]]), len(spans), ",".join(sorted({KINDS[k] for _, _, k, _ in spans})), min(p for *_, p in spans)))
            cols = list(zip(*rows)) or [[]] * 5
            ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], ["doc_id", "text", "n_spans", "kinds", "least_probability"])

    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return slim.mapInArrow(clean, "doc_id long, text string, n_spans int, kinds string, least_probability double")
