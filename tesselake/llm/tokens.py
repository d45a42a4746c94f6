"""Token counts, and byte-level encoding and decoding, by compiled finite-state tokenizers.

Both run the transducers of :mod:`tesselake.llm.bpe` one text segment at a time. No piece joins a
segment to the next, so the transducer is back in its start state at every segment, and a whole segment
is one transition of the tokenizer: its result is kept in a bounded memo.

Defined cases: a null text counts as empty; an empty text has no tokens; a text may be of any length;
repeated rows are repeated in the result; an empty table gives an empty result; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselake.llm.bpe import Transducer, piece_vocabulary, rank_vocabulary
from tesselake.llm.common import make_room, owned, slices

#: Segments whose result a worker keeps at once.
MEMO = 60_000
#: Characters of a text that are mapped as one chunk.
CHUNK = 1 << 18


class Memo(dict):
    """Results by segment, in two generations of bounded size: what was asked for lately outlives what wasn't."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


# --- counts -------------------------------------------------------------------------------------

#: The mark that stands for a space; a text gets one in front.
MARK = "▁"


class PieceCounter:
    """Counts pieces of whole texts by composing the state maps of their chunks.

    The map of a chunk takes the state at its entry to the state at its exit and the tokens between. It
    is constant beyond the chunk's first segment start, so it is kept as (head: what comes before that
    start, count of the complete segments, tail: the open segment at the end), or as a head alone if no
    segment starts. Composing two maps is associative; a prefix scan pairs neighbours up level by level.
    """

    def __init__(self, model: str):
        self.transducer = Transducer(piece_vocabulary(model), counts=True)
        self.words = Memo(lambda w: self.transducer.number(MARK + w))
        self.runs = Memo(self.transducer.number)
        self.start = re.compile(f"(?<!{MARK}){MARK}")
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")

    def chunk_map(self, chunk: str, before: str) -> tuple:
        """before: the character in front of the chunk; a run of marks across the cut starts no segment."""
        at = self.start.search(chunk) if before != MARK else self.start.search(chunk, len(chunk) - len(chunk.lstrip(MARK)))
        if at is None:
            return (chunk, None, "")
        head, rest = chunk[: at.start()], chunk[at.start() :]
        if MARK + MARK in rest:
            segments = self.cut.findall(rest)
            return (head, sum(map(self.runs.__getitem__, segments[:-1])), segments[-1])
        words = rest.split(MARK)
        return (head, sum(map(self.words.__getitem__, words[1:-1])), MARK + words[-1])

    def compose(self, a: tuple, b: tuple) -> tuple:
        if b[1] is None:
            return (a[0] + b[0], None, "") if a[1] is None else (a[0], a[1], a[2] + b[0])
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        return (a[0], a[1] + self.runs[a[2] + b[0]] + b[1], b[2])

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        maps = [self.chunk_map(text[i : i + chunk], text[i - 1] if i else "") for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, count, tail = maps[0]
        return (self.runs[head] if head else 0) + (count or 0) + (self.runs[tail] if tail else 0)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column("text").to_pylist()]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every text; one narrow pass, no shuffle."""

    def count(batches):
        counter = owned((PieceCounter, model), lambda: PieceCounter(model))
        for batch in slices(batches):
            texts = _texts(batch)
            n = np.fromiter(map(counter.count, texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    make_room(docs.sparkSession)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return some.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


# --- byte-level encoding and decoding -----------------------------------------------------------

#: White space as the patterns of byte-level vocabularies mean it: the Unicode property, fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Characters that are neither letters, numbers nor white space.
MARKS = frozenset(".,;:!?|%&*$#")


def compiled(pattern: str):
    """The pattern with \\s and \\S spelled out, so that no library's own idea of white space counts."""
    pattern = pattern.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")
    return regex.compile(pattern)


class Utf8States:
    """An incremental UTF-8 decoder as a state machine whose transitions on whole tokens are tabled.

    State 0 is between characters, 1 to 3 wait for that many continuation bytes, 4 to 7 are after E0, ED,
    F0 and F4, whose second byte is restricted, 8 has met an error. A token's map takes each state to another.
    """

    START, ERROR = 0, 8

    def __init__(self, names: list[bytes]):
        maps = np.array([[self.read(s, name) for s in range(9)] for name in names], np.uint8).reshape(-1, 9)
        self.maps, self.plain = maps, maps[:, 0] == 0

    @staticmethod
    def byte(state: int, b: int) -> int:
        if state == 0:
            if b < 0x80:
                return 0
            if 0xC2 <= b <= 0xDF:
                return 1
            return {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}.get(b, 2 if 0xE1 <= b <= 0xEF else 3 if 0xF1 <= b <= 0xF3 else 8)
        low, high, then = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2), 8: (1, 0, 8)}[state]
        return then if low <= b <= high else 8

    @classmethod
    def read(cls, state: int, piece: bytes) -> int:
        for b in piece:
            state = cls.byte(state, b)
        return state

    def final(self, ids: np.ndarray) -> int:
        """State after all tokens; only those that start or end inside a character are stepped through."""
        state, i = 0, 0
        odd = np.flatnonzero(~self.plain[ids])
        k = 0
        while k < len(odd):
            i = odd[k]
            state = int(self.maps[ids[i], 0])
            while state not in (0, 8) and (i := i + 1) < len(ids):
                state = int(self.maps[ids[i], state])
            if state:
                return state
            k = int(np.searchsorted(odd, i, side="right"))
        return state


class ByteCodec:
    """Encodes texts by ranks, each match of the pattern separately, and decodes ids back to bytes."""

    def __init__(self, ranks: str, pattern: str):
        vocabulary, self.names = rank_vocabulary(ranks)
        coded = [n.to_bytes(4, "little") for n in range(len(self.names))]
        self.transducer = Transducer(vocabulary, code=lambda ids: b"".join([coded[n] for n in ids]))
        self.find = compiled(pattern).finditer
        self.utf8 = Utf8States(self.names)
        self.matches = Memo(self._match)
        self.first = Memo(self._segment, MEMO // 4)
        self.later = Memo(lambda w: self._segment(" " + w))
        self.broken = re.compile(f"[{SPACE}][{SPACE}]|^[{SPACE}]|[{SPACE}]\\Z")

    def _match(self, match: str) -> bytes:
        return b"".join(self.transducer.emitted(match.encode("utf-8", "surrogatepass")))

    def _segment(self, segment: str) -> bytes:
        """A space or none and then letters are one match, a mark behind them another; else the pattern tells."""
        word = segment[segment[:1] == " " :]
        if word.isalpha():
            return self._match(segment)
        if word[-1:] in MARKS and word[:-1].isalpha():
            return self.matches[segment[:-1]] + self.matches[segment[-1]]
        return b"".join([self.matches[m[0]] for m in self.find(segment)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A single space between two other characters always starts a match, so such a text is cut there;
        one with longer white space, or with white space at an end, is matched as a whole.
        """
        if self.broken.search(text):
            return b"".join([self.matches[m[0]] for m in self.find(text)])
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.later.__getitem__, rest)) if text else b""

    def decode(self, ids: bytes) -> tuple[bytes, bool]:
        """The bytes, and whether they are whole UTF-8 characters."""
        n = np.frombuffer(ids, "<u4")
        return b"".join(map(self.names.__getitem__, n.tolist())), self.utf8.final(n) == Utf8States.START


def byte_bpe(docs: DataFrame, ranks: str, pattern: str, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip of every text; with ``ids`` also the ids. One narrow pass."""

    def code(batches):
        codec = owned((ByteCodec, ranks, pattern), lambda: ByteCodec(ranks, pattern))
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            for text in _texts(batch):
                coded = codec.encode(text)
                decoded, whole = codec.decode(coded)
                found = (len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded).hexdigest(), whole and decoded == text.encode("utf-8", "surrogatepass"), np.frombuffer(coded, "<i4") if ids else None)
                for column, x in zip(columns, found, strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 5 if ids else 4]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids"][: len(arrays)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    make_room(docs.sparkSession)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return some.mapInArrow(code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids)
