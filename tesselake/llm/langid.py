"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of the words of labelled text. A text is parsed, word by word, into the longest
phrases that occur in the language's words; the language that needs the fewest phrases, each counted with the bits
that point into its labelled text, wins. A phrase never crosses a word, so the phrases of a token are found once and
kept in a bounded table.

Defined cases: a null text, an empty one and one without a letter give ``und`` and score 0; ties go to the
language whose name sorts first; texts of any length are parsed whole, in training as well; repeated rows are
repeated; an empty table gives an empty result; without any labelled text every prediction is ``und``; columns other
than the id, the text and (in training) the language are not read; ``identified`` carries all columns through, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselake.llm.automaton import SuffixAutomaton
from tesselake.llm.common import TokenTable, held_out, make_room, owned, pick, slices

UNDETERMINED = "und"
#: Labelled documents of each language that the automata are fitted on, all of their text.
SAMPLE_DOCS = 80
#: Letters of a language whose moves are a table's columns.
WIDEST = 120

_LETTERS = re.compile(r"[^\W\d_]+")


class Parser:
    """An automaton's moves as a table over its WIDEST most frequent letters, so that many words are parsed at once.

    Words that hold another of its letters go through the automaton itself.
    """

    def __init__(self, automaton: SuffixAutomaton):
        self.automaton = automaton
        counts = Counter(symbol for moves in automaton.moves for symbol in moves)
        usual = [c for c, _ in counts.most_common(WIDEST) if ord(c) < 1 << 16]
        self.rare = frozenset(counts) - frozenset(usual)
        column = {c: k for k, c in enumerate(usual, 1)}
        self.column = np.zeros(1 << 16, np.uint8)
        self.column[[ord(c) for c in usual]] = np.arange(1, len(usual) + 1)
        self.table = np.full((len(automaton.moves), len(usual) + 1), -1, np.int32)  # a letter that the automaton lacks is column 0
        for state, moves in enumerate(automaton.moves):
            for symbol, to in moves.items():
                if symbol in column:
                    self.table[state, column[symbol]] = to

    def phrases(self, words: list[str]) -> np.ndarray:
        """Phrases of the greedy parse of each word, as ``SuffixAutomaton.phrases`` counts them."""
        n = np.zeros(len(words), np.int64)
        if not words:
            return n
        codes = self.column[np.minimum(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), (1 << 16) - 1)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        longer = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")  # words longer than each place
        state, found = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for j, m in enumerate(longer.tolist()):
            c = codes[starts[:m] + j]
            to = self.table[state[:m], c]
            lost = np.flatnonzero(to < 0)
            again = self.table[0, c[lost]]
            found[lost] += (state[lost] != 0).astype(np.int64) + (again < 0)
            to[lost] = np.maximum(again, 0)
            state[:m] = to
        n[order] = found + (state != 0)
        if self.rare:
            for k, word in enumerate(words):
                if not self.rare.isdisjoint(word):
                    n[k] = self.automaton.phrases(word)
        return n


class CrossParser:
    """Automata of all languages, and the phrase counts of tokens met.

    The more text an automaton holds, the longer its phrases are by chance, so a language's phrases count
    as many bits as it takes to point into its text: the logarithm of the text's length.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        self.parsers = [Parser(SuffixAutomaton(f"^{w}$" for w in samples[x])) for x in self.langs]
        self.bits = np.array([math.log2(2 + sum(len(w) + 2 for w in samples[x])) for x in self.langs])
        self.table = TokenTable(self.figures)

    def figures(self, tokens: list[str]) -> np.ndarray:
        """For each token its letters, then the phrases that each language needs; a space-delimited token may hold several words."""
        words, owner = [], []
        for k, token in enumerate(tokens):
            found = _LETTERS.findall(token.lower())
            words += found
            owner += [k] * len(found)
        marked = [f"^{w}$" for w in words]
        figures = [np.fromiter(map(len, words), np.int64, len(words)), *(p.phrases(marked) for p in self.parsers)]
        return np.stack([np.bincount(owner, x, len(tokens)) for x in figures], axis=1).astype(np.int64)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """The language of each text, and the share of the bits of the best two that the second needs."""
        langs, scores = [], []
        figures, starts = self.table.read(texts)
        total = np.concatenate([np.zeros((1, figures.shape[1]), np.int64), np.cumsum(figures, axis=0)])
        total = total[starts[1:]] - total[starts[:-1]]
        for letters, bits in zip(total[:, 0].tolist(), total[:, 1:] * self.bits, strict=True):
            if not letters or not self.langs:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmin(bits))
            rest = float(np.delete(bits, best).min(initial=np.inf)) if len(bits) > 1 else 0.0
            langs.append(self.langs[best])
            scores.append(rest / (rest + float(bits[best])) if rest else 1.0)
        return langs, scores


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Distinct words by language of the whole texts of at most SAMPLE_DOCS labelled documents a language.

    The documents are picked by a hash of their id; those that are held out are never read. Where rows of an id have
    different texts the first in order is taken.
    """
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    some = some.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    picked = pick(some, "lang", SAMPLE_DOCS)
    texts = some.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    samples: dict[str, dict] = {}
    for row in texts.select("lang", "text").toLocalIterator():
        samples.setdefault(row["lang"], {}).update(dict.fromkeys(_LETTERS.findall(row["text"].lower())))
    return {lang: sorted(words) for lang, words in samples.items() if words}


def _shared(docs: DataFrame, samples: dict[str, list[str]]):
    """Gives each worker its own automata: only the words of the samples (bounded) are sent."""
    key = (CrossParser, hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest())
    make_room(docs.sparkSession)
    words = docs.sparkSession.sparkContext.broadcast(samples)
    return lambda: owned(key, lambda: CrossParser(words.value))


def identify(docs: DataFrame, samples: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text; one narrow pass, no shuffle."""
    shared = _shared(docs, samples)

    def predict(batches):
        parser = shared()
        for batch in slices(batches):
            langs, scores = parser.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    some = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return some.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """The documents in a language that was learned, with all their columns."""
    shared = _shared(docs, samples)

    def keep(batches):
        parser = shared()
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array([x != UNDETERMINED for x in parser.predict(batch.column(text_col).to_pylist())[0]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
