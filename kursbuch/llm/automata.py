"""Probabilistic automata inferred from example strings by merging the states of their prefix tree."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping

#: Confidence parameter of the Hoeffding bound in the compatibility test.
ALPHA = 0.05
#: Symbols that an automaton can meet: d h l H u, the signs of a token, and the end of a string.
ALPHABET = 12
END = ""
#: Share of every step's probability that goes by the frequency of its symbol, whatever the state.
SMOOTH = 0.05


def symbol(c: str) -> str:
    """The alphabet of the automata: classes of characters."""
    if c.isdigit():
        return "d"
    if c in "abcdef":
        return "h"
    if c in "ABCDEF":
        return "H"
    if c.islower():
        return "l"
    return "u" if c.isupper() else c


_CLASSES = {i: symbol(chr(i)) for i in range(128)}


def follow(node: int, c: str) -> int:
    """The name of the place in a prefix tree that a symbol leads to from another; the root is 0."""
    x = (node * 0x5851F42D4C957F2D + ord(c) * 0x14057B7EF767814F + 1) & ((1 << 63) - 1)
    return x ^ (x >> 29)


def classes(token: str) -> str:
    return token.translate(_CLASSES) if token.isascii() else "".join(map(symbol, token))


class Automaton:
    """A probabilistic deterministic automaton inferred by state merging (ALERGIA).

    The sample becomes a prefix tree whose states count how many strings pass, end and go on by each
    symbol. Kept states are red; what a red state leads to and is not red itself is blue. Until no
    state is blue, the blue one that most strings pass is folded into the first red state with
    compatible frequencies (by the Hoeffding bound, along all common continuations), or
    becomes red. Blue states are looked up anew after every fold, so whatever a fold brings to a
    red state is examined too, and no string of the sample can leave the automaton.

    Examples are held whole. Where a single one goes on, its rest is not written out as states but kept
    as a tail (string, place, count), so the tree is as large as the places where examples part.
    """

    def __init__(self, strings: Iterable[str] | Mapping[str, int], alpha: float = ALPHA):
        counts = strings if isinstance(strings, Mapping) else Counter(map(classes, strings))
        self.to: list[dict[str, int]] = []
        self.by: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.passes: list[int] = []
        self.tail: list[tuple[str, int, int] | None] = []
        self._state()
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s, n in sorted(counts.items()):
            self.passes[0] += n
            self._add(0, s, 0, n)
        self._merge()
        self._weigh()

    @classmethod
    def of_tree(cls, tree: Mapping[int, Mapping[str, int]], alpha: float = ALPHA) -> Automaton:
        """The states of a counted prefix tree: of each of its nodes (named by ``follow``) the counts by symbol and END.
        Symbols may lead out of the tree, to places that too few strings pass to be told apart; such a step stays at its state.
        ``weigh`` has to give the counts of whole strings then."""
        self = cls({}, alpha)
        at = {0: 0}
        todo = [0] if 0 in tree else []
        while todo:
            node = todo.pop()
            x = at[node]
            for c, n in sorted(tree[node].items()):
                self.passes[x] += n
                if c == END:
                    self.ends[x] = n
                    continue
                self.by[x][c] = n
                child = follow(node, c)
                if child in tree:
                    self.to[x][c] = at[child] = self._state()
                    todo.append(child)
        self._merge()
        return self

    def weigh(self, counts: Mapping[tuple[int, str], int]) -> Automaton:
        """Takes, for each state and symbol or END, how many of all strings took that step."""
        self.by = [{} for _ in self.to]
        self.ends = [0] * len(self.to)
        for (x, c), n in sorted(counts.items()):
            if c == END:
                self.ends[x] = n
            else:
                self.by[x][c] = n
        self.passes = [sum(by.values()) + ends for by, ends in zip(self.by, self.ends, strict=True)]
        self._weigh()
        return self

    def _state(self) -> int:
        for column, empty in ((self.to, {}), (self.by, {}), (self.ends, 0), (self.passes, 0), (self.tail, None)):
            column.append(empty)
        return len(self.to) - 1

    def _open(self, x: int) -> None:
        """Writes out the first step of a state's tail."""
        if self.tail[x] is not None:
            s, at, n = self.tail[x]
            self.tail[x] = None
            self._step(x, s, at, n)

    def _step(self, x: int, s: str, at: int, n: int) -> None:
        """The rest of a string goes on from an open state by a symbol that it has not: a new state with a tail."""
        self.to[x][s[at]] = y = self._state()
        self.by[x][s[at]] = self.passes[y] = n
        if at + 1 == len(s):
            self.ends[y] = n
        else:
            self.tail[y] = (s, at + 1, n)

    def _add(self, x: int, s: str, at: int, n: int) -> None:
        """Adds n times the rest of a string to what is below x; x itself counts it already."""
        while at < len(s):
            self._open(x)
            c = s[at]
            if c not in self.to[x]:
                self._step(x, s, at, n)
                return
            self.by[x][c] += n
            x = self.to[x][c]
            self.passes[x] += n
            at += 1
        self.ends[x] += n

    def _look(self, x):
        """passes, ends, counts by symbol and next states, of a state or a place in a tail."""
        if isinstance(x, int):
            if self.tail[x] is None:
                return self.passes[x], self.ends[x], self.by[x], self.to[x]
            x = self.tail[x]
        s, at, n = x
        return (n, n, {}, {}) if at == len(s) else (n, 0, {s[at]: n}, {s[at]: (s, at + 1, n)})

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            n, ends, by, to = self._look(x)
            m, other_ends, other_by, other_to = self._look(y)
            if not n or not m or self._bound / math.sqrt(m) >= 1:
                continue  # one string alone, here and further down, differs from nothing
            if self._differ(ends, n, other_ends, m):
                return False
            for c in by.keys() | other_by.keys():
                if self._differ(by.get(c, 0), n, other_by.get(c, 0), m):
                    return False
            # below the blue state lies a tree, so the walk ends
            todo += [(to[c], other_to[c]) for c in to.keys() & other_to.keys()]
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Adds the tree below blue to red."""
        todo = [(red, blue)]
        while todo:
            x, y = todo.pop()
            self.passes[x] += self.passes[y]
            if self.tail[y] is not None:
                self._add(x, *self.tail[y])
                continue
            self._open(x)
            self.ends[x] += self.ends[y]
            for c, n in self.by[y].items():
                self.by[x][c] = self.by[x].get(c, 0) + n
                if c not in self.to[y]:
                    continue  # it leads out of a counted tree
                if c in self.to[x]:
                    todo.append((self.to[x][c], self.to[y][c]))
                else:
                    self.to[x][c] = self.to[y][c]

    def _merge(self) -> None:
        red = [0]
        kept = {0}
        while True:
            for r in red:
                self._open(r)
            blue = [(-self.passes[t], r, c, t) for r in red for c, t in self.to[r].items() if t not in kept]
            if not blue:
                break
            _, r, c, t = min(blue)
            match = next((q for q in red if self._compatible(q, t)), None)
            if match is None:
                red.append(t)
                kept.add(t)
            else:
                self.to[r][c] = match
                self._fold(match, t)
        # red states alone are kept, by their places in the list
        number = {s: i for i, s in enumerate(red)}
        self.to = [{c: number[t] for c, t in self.to[s].items()} for s in red]
        self.by, self.ends, self.passes = [self.by[s] for s in red], [self.ends[s] for s in red], [self.passes[s] for s in red]
        self.tail = [None] * len(red)
        self.states = len(red)

    def _weigh(self) -> None:
        symbols: Counter[str] = Counter()
        for by, ends in zip(self.by, self.ends, strict=True):
            symbols.update(by)
            symbols[END] += ends
        total = symbols.total() + 0.5 * ALPHABET
        #: Of each symbol, the logarithm of its smoothed share; None stands for symbols that were never seen.
        self.rare = {c: math.log(SMOOTH * (n + 0.5) / total) for c, n in symbols.items()} | {None: math.log(SMOOTH * 0.5 / total)}
        #: Of each state: its steps, as log-probability and next state, and the log-probability that a string ends there.
        self.table: list[dict[str, tuple[float, int]]] = []
        self.stop: list[float] = []
        for at, (to, by, ends, passes) in enumerate(zip(self.to, self.by, self.ends, self.passes, strict=True)):
            n_s = max(1, passes)
            smoothed = {c: math.log((1 - SMOOTH) * n / n_s + math.exp(self.rare[c])) for c, n in {**by, END: ends}.items()}
            self.stop.append(smoothed.pop(END))
            self.table.append({c: (p, to.get(c, at)) for c, p in smoothed.items()})

    def path(self, s: str) -> Iterable[int | None]:
        """The states that a class string goes through; None where it leaves them."""
        at: int | None = 0
        for c in s:
            step = self.table[at].get(c) if at is not None else None
            at = step[1] if step else None
            yield at

    def score(self, s: str) -> float:
        return self.score_classes(classes(s))

    def likelihood(self, s: str) -> float:
        """Log-likelihood of a class string as a whole, its end included. A step that its state has not seen
        counts by the symbol alone, and leads back to the first state."""
        at, total = 0, 0.0
        for c in s:
            step = self.table[at].get(c)
            if step is None:
                total, at = total + self.rare.get(c, self.rare[None]), 0
            else:
                total, at = total + step[0], step[1]
        return total + self.stop[at]

    def score_classes(self, s: str) -> float:
        """Mean log-likelihood of a symbol, the end being one."""
        return self.likelihood(s) / (len(s) + 1)
