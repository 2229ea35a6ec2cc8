"""Backtracking encoding of many words at once.

``Lockstep`` runs the backtracking of ``pieces`` for all distinct parts of a
slice of texts together: every numpy step moves each unfinished part by one
accepted, refused or taken-back piece, so there is no Python work per word.
All memory besides the model's own tables is bounded: pairs are remembered in
a table of fixed size, where a newer pair takes the place of an older one.
"""

from __future__ import annotations

import numpy as np

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Places of the memory of pairs.
PAIR_BITS = 20


class Table:
    """A fixed map of non-negative integers to integers, looked up by arrays; -1 for what it lacks."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[todo[won]], values[todo[won]]
            rest = np.ones(len(todo), dtype=bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLY) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Matcher:
    """An Aho-Corasick automaton of the reversed pieces, which reads texts from the right.

    Its state before a character knows the longest piece that begins there;
    ``shorter`` has the next shorter piece with the same beginning.
    """

    def __init__(self, pieces: list[np.ndarray]) -> None:
        """``pieces``: each one's character classes, from 1 on."""
        lens = np.array([len(p) for p in pieces])
        starts = np.cumsum(lens) - lens
        flat = np.concatenate(pieces)
        state, parents, classes, ranges = np.zeros(len(pieces), dtype=np.int64), [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], []
        count = 1
        for depth in range(int(lens.max())):
            own = np.flatnonzero(lens > depth)
            key = state[own] << 16 | flat[starts[own] + lens[own] - 1 - depth]
            new, at = np.unique(key, return_inverse=True)
            state[own] = count + at
            parents.append(new >> 16), classes.append(new & 0xFFFF), ranges.append((count, count + len(new)))
            count += len(new)
        parent, cls = np.concatenate(parents), np.concatenate(classes)
        self.step = Table((parent << 16 | cls)[1:], np.arange(1, count, dtype=np.int32))
        own = np.full(count, -1, dtype=np.int32)
        own[state] = np.arange(len(pieces), dtype=np.int32)
        self.fail = np.zeros(count, dtype=np.int64)
        longest, below = own.copy(), np.full(count, -1, dtype=np.int32)  # of proper suffixes
        for a, b in ranges:
            if a > 1:
                self.fail[a:b] = self.move(self.fail[parent[a:b]], cls[a:b])
            below[a:b] = longest[self.fail[a:b]]
            longest[a:b] = np.where(own[a:b] >= 0, own[a:b], below[a:b])
        self.longest = longest
        self.shorter = below[state]

    def move(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        to = self.step.get(state << 16 | cls).astype(np.int64)
        todo = np.flatnonzero((to < 0) & (state > 0))
        back = state
        if len(todo):
            back = state.copy()
        while len(todo):
            back[todo] = self.fail[back[todo]]
            to[todo] = self.step.get(back[todo] << 16 | cls[todo])
            todo = todo[(to[todo] < 0) & (back[todo] > 0)]
        return np.maximum(to, 0)


class Lockstep:
    """``pieces``: texts of the pieces, each character of which is a piece too; ``scores`` of these."""

    def __init__(self, pieces: list[str], scores: list[float]) -> None:
        own = {p: k for k, p in enumerate(pieces)}
        singles = [p for p in pieces if len(p) == 1]
        if len(singles) >= 1 << 16:
            raise ValueError("too many characters")
        self.classes = np.zeros(0x110000, dtype=np.int64)
        self.single = np.full(len(singles) + 1, -1, dtype=np.int64)  # of a class the piece
        for k, c in enumerate(singles):
            self.classes[ord(c)] = k + 1
            self.single[k + 1] = own[c]
        chars = [self.classes[np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)] for p in pieces]
        if any((c == 0).any() for c in chars):
            raise ValueError("a piece has a character that is no piece")
        self.count = len(pieces)
        self.size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.matcher = Matcher(chars)
        self.letters = np.concatenate([self.single[c] for c in chars])
        self.first = np.cumsum(self.size) - self.size
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int64)
        pairs = [(own[a] * (self.count + 1) + own[b], k) for p, k in own.items() for n in range(1, len(p)) if (a := p[:n]) in own and (b := p[n:]) in own]
        self.joined = Table(np.array([k for k, _ in pairs], dtype=np.int64), np.array([v for _, v in pairs], dtype=np.int32))
        self.known = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.verdict = np.zeros(1 << PAIR_BITS, dtype=bool)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether re-merging the characters of ``a`` (``count`` for none) and ``b`` gives back these two."""
        key = a * (self.count + 1) + b
        slot = ((key.astype(np.uint64) * _MULTIPLY) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.verdict[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            keys, at = np.unique(key[new], return_inverse=True)
            got = self._merge_back(keys // (self.count + 1), keys % (self.count + 1))
            out[new] = got[at]
            # of pairs that share a place the last one written stays, key and verdict alike
            place, last = np.unique(slot[new][::-1], return_index=True)
            chosen = new[::-1][last]
            self.known[place], self.verdict[place] = key[chosen], out[chosen]
        return out

    def _merge_back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        none = a == self.count
        left = np.where(none, 0, self.size[np.minimum(a, self.count - 1)])
        total = left + self.size[b]
        for low, high in ((0, 8), (8, 16), (16, 1 << 30)):
            some = np.flatnonzero((total > low) & (total <= high))
            for k in range(0, len(some), 1 << 14):
                own = some[k : k + (1 << 14)]
                out[own] = self._merge_group(a[own], b[own], left[own], total[own])
        return out

    def _merge_group(self, a: np.ndarray, b: np.ndarray, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        n, width = len(a), int(total.max())
        far = np.int64(1 << 40)
        col = np.arange(width + 1)[None, :]
        at = np.where(col < left[:, None], self.first[np.minimum(a, self.count - 1)][:, None] + col, self.first[b][:, None] + col - left[:, None])
        tokens = np.where(col < total[:, None], self.letters[np.minimum(at, len(self.letters) - 1)], -1)

        def ranks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = np.full(len(x), -1, dtype=np.int64)
            both = np.flatnonzero((x >= 0) & (y >= 0))
            got[both] = self.joined.get(x[both] * (self.count + 1) + y[both])
            return got, np.where(got >= 0, self.rank[got], far)

        made, rank = (v.reshape(n, width) for v in ranks(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()))
        length, active = total.copy(), np.arange(n)
        while len(active):
            j = rank[active].argmin(axis=1)
            best = rank[active, j] < far
            active, j = active[best], j[best]
            if not len(active):
                break
            tokens[active, j] = made[active, j]
            shift = np.minimum(col + (col > j[:, None]), width)
            tokens[active] = np.take_along_axis(tokens[active], shift, axis=1)
            tokens[active, width] = -1
            inner = np.minimum(shift[:, :-1], width - 1)
            made[active], rank[active] = np.take_along_axis(made[active], inner, axis=1), np.take_along_axis(rank[active], inner, axis=1)
            length[active] -= 1
            rank[active, width - 1] = far
            for side in (-1, 0):
                k = j + side
                fine = k >= 0
                rows, k = active[fine], k[fine]
                k = np.minimum(k, width - 1)
                made[rows, k], rank[rows, k] = ranks(tokens[rows, k], tokens[rows, k + 1])
        none = a == self.count
        two = ~none & (length == 2) & (tokens[:, 0] == a) & (tokens[:, min(1, width)] == b)
        return two | (none & (length == 1) & (tokens[:, 0] == b))

    def tokens(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of flat code points, parted at ``starts``, the piece that begins at each; -1 for none.

        Characters without a piece part what is around them.
        """
        n = len(codes)
        cls = self.classes[codes]
        longest = self._longest(cls, starts)
        known = cls > 0
        begin = known.copy()
        begin[1:] &= ~known[:-1]
        begin[starts[known[starts]]] = True
        at = np.flatnonzero(begin)
        stop = np.zeros(n + 1, dtype=bool)
        stop[n] = True
        stop[:-1] = begin | ~known
        out = np.full(n, -1, dtype=np.int64)
        before = np.full(n + 1, -1, dtype=np.int64)  # where the piece that ends at a place begins
        failed = np.zeros(n + 1, dtype=bool)
        last, option = np.full(len(at), self.count, dtype=np.int64), longest[at].astype(np.int64)
        while len(at):
            empty = option < 0
            ahead = at + self.size[option]
            fits = np.zeros(len(at), dtype=bool)
            ask = np.flatnonzero(~empty & ~failed[np.minimum(ahead, n)])
            fits[ask] = self._compatible(last[ask], option[ask])
            # accepted: on to the place after it
            go = np.flatnonzero(fits)
            out[at[go]], before[ahead[go]] = option[go], at[go]
            # refused: the next shorter one
            wait = np.flatnonzero(~fits & ~empty)
            option[wait] = self.matcher.shorter[option[wait]]
            # none left: the place has failed, and the piece before it is taken back
            back = np.flatnonzero(empty)
            if len(back):
                failed[at[back]] = True
                at[back] = before[at[back]]
                if (at[back] < 0).any():
                    raise ValueError("a text can't be parted into compatible pieces")
                taken = out[at[back]]
                out[at[back]] = -1
                option[back] = self.matcher.shorter[taken]
                first = begin[at[back]]
                earlier = before[at[back]]
                last[back] = np.where(first, self.count, out[np.where(first, 0, earlier)])
            at[go], last[go] = ahead[go], option[go]
            done = np.zeros(len(at), dtype=bool)
            done[go] = stop[at[go]]
            more = go[~done[go]]
            option[more] = longest[at[more]]
            if done.any():
                at, last, option = at[~done], last[~done], option[~done]
        return out

    def _longest(self, cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The longest piece at each place, read from the right of all parts together."""
        out = np.full(len(cls), -1, dtype=np.int32)
        place = np.append(starts[1:], len(cls)) - 1
        own = np.flatnonzero(place >= starts)
        place, floor = place[own], starts[own]
        state = np.zeros(len(place), dtype=np.int64)
        while len(place):
            c = cls[place]
            state = np.where(c > 0, self.matcher.move(state, c), 0)
            out[place] = self.matcher.longest[state]
            place = place - 1
            keep = place >= floor
            if not keep.all():
                place, floor, state = place[keep], floor[keep], state[keep]
        return out
