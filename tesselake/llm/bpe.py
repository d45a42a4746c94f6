"""Byte-pair vocabularies as lazily determinised finite-state transducers.

A piece ends the encoding of a prefix if and only if it forms a stable pair with the piece that ends
the encoding of what stands before it, so the encoding of every prefix follows from those of a few
shorter ones. Only the starts from which the text read so far may still grow into a longer piece
matter: a state holds, for each of them, its place in the trie of pieces, the last piece before it and
the pieces not emitted yet. What all of them agree on is emitted: the lookahead is bounded by the
longest piece. States and transitions are made when first met, and dropped together when there are
too many of them, so memory is bounded whatever the text.
"""

from __future__ import annotations

import base64


#: Results that a vocabulary or transducer keeps of each kind, to make states faster.
CACHED = 50_000


class Vocabulary:
    """Pieces with ids and merge priorities (lower first, ties leftmost); symbols are str or bytes of length 1."""

    def __init__(self, pieces: dict, priority: dict):
        self.ids, self.priority = pieces, priority
        self.names = {n: p for p, n in pieces.items()}
        root: dict = {}
        for piece, n in pieces.items():
            node = root
            for symbol in piece:
                node = node.setdefault(symbol, {})
            node[None] = n
        self.root = root
        self._stable: dict = {}
        self._own: dict = {}
        self._whole: dict = {}

    def merge(self, text) -> list:
        """Pieces of a short text by repeated merges: the definition the transducer is compiled from."""
        parts = [text[i : i + 1] for i in range(len(text))]
        get = self.priority.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = get(parts[i] + parts[i + 1])
                if p is not None and (best is None or p < best):
                    best, at = p, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spines(self, n: int) -> tuple[list, list]:
        """How the first and the last part of a piece's own text grow: (part, priority of the merge that made it) lists."""
        found = self._own.get(n)
        if found is None:
            piece = self.names[n]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            first, last = [(parts[0], None)], [(parts[-1], None)]
            get = self.priority.get
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    p = get(parts[i] + parts[i + 1])
                    if p is not None and (best is None or p < best):
                        best, at = p, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    first.append((parts[0], best))
                if at == len(parts) - 1:
                    last.append((parts[-1], best))
            if len(self._own) > CACHED // 4:
                self._own.clear()
            found = self._own[n] = (first, last)
            self._whole[n] = len(parts) == 1
        return found

    def own(self, n: int) -> bool:
        """Whether merging a piece's own text yields that piece (else no text ever does)."""
        if n not in self._whole:
            self._spines(n)
        return self._whole[n]

    def stable(self, a: int, b: int) -> bool:
        """Whether merging the text of two pieces leaves just these two.

        Only a merge across their border could join them. The part before the border and the part after it
        grow by merges of known priorities; a merge of the two comes about if its priority is before the next
        merge of the left part, and not after that of the right one (of equal merges the left one goes first).
        """
        found = self._stable.get((a, b))
        if found is None:
            if len(self._stable) > CACHED:
                self._stable.clear()
            left, right = self._spines(a)[1], self._spines(b)[0]
            i, j, found, get = 0, 0, True, self.priority.get
            while found:
                p = left[i + 1][1] if i + 1 < len(left) else None
                q = right[j + 1][1] if j + 1 < len(right) else None
                c = get(left[i][0] + right[j][0])
                if c is not None and (p is None or c < p) and (q is None or c <= q):
                    found = False
                elif p is None and q is None:
                    break
                elif q is None or p is not None and p <= q:
                    i += 1
                else:
                    j += 1
            self._stable[a, b] = found
        return found


#: A start whose place in the trie has at most so many pieces below keeps those that can still end there, not the piece before it.
NARROW = 12


class Transducer:
    """Reads symbols and emits what ``code`` makes of the ids of pieces; with ``counts`` their number alone.

    A state is the dictionary of its transitions: symbol to (next state, emitted). Under None it keeps what
    defines it, and what is still to be emitted if the text ends there.
    """

    def __init__(self, vocabulary: Vocabulary, counts: bool = False, max_states: int = 150_000, code=tuple):
        self.v, self.counts, self.max_states, self.code = vocabulary, counts, max_states, code
        self.below: dict = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict = {}
        self.narrowed: dict = {}
        self.start = self._state(((0, None, None, 0 if self.counts else ()),), (self.v.root,))

    def _state(self, key: tuple, nodes: tuple) -> dict:
        found = self.states.get(key)
        if found is None:
            pending = key[-1][3]  # the last start is the end of what was read
            found = self.states[key] = {None: (key, nodes, pending if self.counts else self.code(pending))}
        return found

    def _below(self, node: dict) -> frozenset | None:
        """The pieces strictly below a place of the trie, if they are few."""
        found = self.below.get(id(node), 0)
        if found == 0:
            some: list | None = []
            for symbol, child in node.items():
                if symbol is not None:
                    more = self._below(child)
                    if more is None or len(some) + len(more) + 1 > NARROW:
                        some = None
                        break
                    some += [*more, *([child[None]] if None in child else [])]
            found = self.below[id(node)] = None if some is None else frozenset(some)
        return found

    def _narrow(self, node: dict, last, allowed):
        """What decides about a start: the piece before it, or the few pieces that can still end there."""
        k = (id(node), last, allowed)
        found = self.narrowed.get(k)
        if found is None:
            below = self._below(node)
            if below is None:
                found = (last, None)
            elif allowed is None:
                found = (None, frozenset(n for n in below if self.v.own(n) and (last is None or self.v.stable(last, n))))
            else:
                found = (None, below & allowed)
            if len(self.narrowed) > CACHED:
                self.narrowed.clear()
            self.narrowed[k] = found
        return found

    def _step(self, state: dict, symbol):
        """The transition on a symbol: (next state, what is emitted); None where no piece covers the symbol."""
        key, nodes, _ = state[None]
        live, live_nodes, new = [], [], None
        for (_, last, allowed, pending), node in zip(key, nodes, strict=True):
            child = node.get(symbol)
            if child is None:
                continue
            n = child.get(None)
            if new is None and n is not None and (n in allowed if allowed is not None else self.v.own(n) and (last is None or self.v.stable(last, n))):
                new = (n, pending + (1 if self.counts else (n,)))
            if len(child) > (n is not None):
                last, allowed = self._narrow(child, last, allowed)
                if allowed is None or allowed:
                    live.append((id(child), last, allowed, pending))
                    live_nodes.append(child)
        if new is None:
            return None
        live.append((0, new[0], None, new[1]))
        live_nodes.append(self.v.root)
        if self.counts:
            emitted = done = min(x[3] for x in live)
            live = [(a, b, c, p - done) for a, b, c, p in live]
        else:
            done, first = 0, new[1]
            shortest = min(len(x[3]) for x in live)
            while done < shortest and all(x[3][done] == first[done] for x in live):
                done += 1
            emitted = self.code(first[:done]) if done else None
            live = [(a, b, c, p[done:]) for a, b, c, p in live]
        move = state[symbol] = (self._state(tuple(live), tuple(live_nodes)), emitted)
        return move

    def _beyond(self, state: dict, symbol):
        """A transition not met before; inside one long text the other states are dropped when there are too many."""
        if len(self.states) > 2 * self.max_states:
            self._reset()
        return self._step(state, symbol)

    def number(self, text) -> int:
        """Number of pieces of a text (needs ``counts``); a symbol without a piece counts as its UTF-8 bytes.

        The text may have any length; memory is that of the states kept.
        """
        if len(self.states) > self.max_states:
            self._reset()
        state, total = self.start, 0
        for symbol in text:
            try:
                state, emitted = state[symbol]
            except KeyError:
                move = self._beyond(state, symbol)
                if move is None:
                    total += state[None][2] + len(symbol.encode("utf-8", "surrogatepass"))
                    state = self.start
                    continue
                state, emitted = move
            if emitted:
                total += emitted
        return total + state[None][2]

    def emitted(self, text) -> list:
        """What is emitted for a text, in pieces of the kind ``code`` makes; every symbol must have a piece."""
        if len(self.states) > self.max_states:
            self._reset()
        state, out = self.start, []
        for symbol in text:
            try:
                state, coded = state[symbol]
            except KeyError:
                move = self._beyond(state, symbol)
                if move is None:
                    raise ValueError(f"the vocabulary has no piece for {symbol!r}") from None
                state, coded = move
            if coded is not None:
                out.append(coded)
        out.append(state[None][2])
        return out


def rank_vocabulary(path: str) -> tuple[Vocabulary, list[bytes]]:
    """A file of base64 pieces and ranks; also the pieces by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    # iterating over bytes gives integers: the trie is keyed by them, merges work on slices
    names = [b""] * (max(ranks.values()) + 1)
    for piece, n in ranks.items():
        names[n] = piece
    return Vocabulary(ranks, ranks), names


def piece_vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece BPE model; control, unknown and byte pieces aren't merged."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    return Vocabulary(ids, {p: -sp.get_score(i) for p, i in ids.items()})
