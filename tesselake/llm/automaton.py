"""A suffix automaton over sequences of symbols, letters of words or words of passages."""

from __future__ import annotations

from itertools import repeat


class SuffixAutomaton:
    """All substrings of some sequences, as a deterministic automaton (one dictionary of moves for each state).

    Each sequence has a rank; ``first`` holds the least rank of the sequences that a state's substrings are in.
    """

    def __init__(self, sequences, ranks=None):
        self.moves, self.link, self.length, self.first = [{}], [-1], [0], [1 << 63]
        for symbols, rank in zip(sequences, repeat(0) if ranks is None else ranks):  # noqa: B905
            last = 0
            for symbol in symbols:
                last = self._add(last, symbol, rank)
        if ranks is not None:
            first, link = self.first, self.link
            for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
                if first[state] < first[link[state]]:
                    first[link[state]] = first[state]

    def _add(self, last: int, c, rank: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        q = moves[last].get(c)
        if q is not None:
            if length[q] != length[last] + 1:
                q = self._split(last, c, q)
            if rank < self.first[q]:
                self.first[q] = rank
            return q
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.first.append(rank)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p != -1:
            q = moves[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c, q: int) -> int:
        moves, link, length = self.moves, self.link, self.length
        clone = len(moves)
        moves.append(dict(moves[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(self.first[q])
        link[q] = clone
        while p != -1 and moves[p].get(c) == q:
            moves[p][c] = clone
            p = link[p]
        return clone

    def phrases(self, symbols) -> int:
        """Phrases of the greedy parse; a symbol that the automaton lacks is a phrase of its own."""
        moves, state, n = self.moves, 0, 0
        root = moves[0]
        for symbol in symbols:
            to = moves[state].get(symbol)
            if to is None:
                n += state != 0
                to = root.get(symbol, 0)
                n += to == 0
            state = to
        return n + (state != 0)

    def matches(self, symbols, window: int, rank: int) -> list[int]:
        """Places where a window ends that occurs in a sequence of a smaller rank.

        The matching statistic is held at the window's length, so the state stands for just the window.
        """
        moves, link, length, first = self.moves, self.link, self.length, self.first
        state, n, found = 0, 0, []
        for i, w in enumerate(symbols):
            to = moves[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = moves[state].get(w)
            if to is None:
                continue
            state, n = to, n + 1
            while length[link[state]] >= window:
                state = link[state]
            if n > window:
                n = window
            if n == window and first[state] < rank:
                found.append(i)
        return found
