"""Toxicity scores by subword-bag embeddings averaged into a linear softmax.

The bag of a token holds the words in it and their character n-grams, hashed into a fixed number of buckets;
a misspelling never seen shares most of a known word's n-grams. A window of WINDOW tokens (a shorter text is one
window) is the average of the embeddings in its tokens' bags, an output layer turns that into two logits, and a
document's score is the softmax of its most toxic window, so a few words in a long text stay visible. Both
layers are trained jointly in numpy on just that: in every epoch each labelled document is represented by the
window that is its most toxic one by then, classes weigh the same, and Adam moves both layers. Training starts
from the buckets' log odds between the classes, and a bucket's steps shrink with the evidence that its documents give.

Because the output layer is linear, a window's logit is the quotient of two sums over its tokens: scoring
keeps two numbers a token in a bounded table.

Defined cases: null and empty texts, and texts without a letter, have no words and score 0; texts of any length are
read whole, in training as well; repeated rows are repeated; ties between windows don't change a score; an empty table
gives an empty result; with few labels the marks they show count little each, but count; with no labels, or labels of
one class only, or no n-gram in LEAST_DOCS labelled documents, every score is 0; columns other than doc_id and text
are not read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselake.llm.common import GOLDEN, TokenTable, held_out, mix64, owned, pick, slices

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 8, 3, 5
#: Labelled documents of each class that the model is fitted on, all of their text.
SAMPLE_DOCS = 600
#: Tokens of a window.
WINDOW = 64
#: A bucket is trained if so many sampled documents hold it: another could only be learned by heart.
LEAST_DOCS = 4
#: Largest log odds to start from (a mark of one language is as good as one of another), standard deviations at which a
#: bucket counts half, and the output layer's weight on the starting odds.
MOST, CHANCE, GAIN = 2.0, 5.0, 20.0
EPOCHS, RATE, THRESHOLD = 30, 0.3, 0.7

_WORD = re.compile(r"[^\W\d_]+")


def bags(tokens: list[str]):
    """(token, bucket) arrays, an entry for each n-gram and each word of each token."""
    words, owner = [], []
    for k, token in enumerate(tokens):
        found = _WORD.findall(token.lower())
        words += found
        owner += [k] * len(found)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes))
    place, left = (at - (ends - sizes)[word]).astype(np.uint64), ends[word] - at
    base = np.uint64(0x9DDFEA08EB382D69)
    whole = np.add.reduceat(mix64(codes * base + place), ends - sizes)
    rows, found = [np.arange(len(words))], [mix64(whole)]
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * base + codes[n - 1 :]
        if n >= SHORTEST:
            inside = np.flatnonzero(left[:m] >= n)
            rows.append(word[inside])
            found.append(mix64(h[inside] + np.uint64(n * int(GOLDEN) % 2**64)))
    return np.asarray(owner, np.int64)[np.concatenate(rows)], (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)


class Model:
    """The trained layers. The difference of the two logits is all that a softmax over two classes needs."""

    def __init__(self, embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.logit = (embeddings @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def figures(self, tokens: list[str]) -> np.ndarray:
        """For each token the sum of its bag's logits, and the size of the bag."""
        token, bucket = bags(tokens)
        return np.stack([np.bincount(token, self.logit[bucket], len(tokens)), np.bincount(token, minlength=len(tokens))], axis=1)


def best_window(figures: np.ndarray, bias: float) -> tuple[float, int]:
    """Largest logit of WINDOW consecutive tokens that hold letters (of all, if fewer), and the first place of it among them."""
    total = np.concatenate([np.zeros((1, 2)), np.cumsum(figures, axis=0)])
    some = total[WINDOW:] - total[:-WINDOW] if len(figures) > WINDOW else total[-1:]
    logits = some[:, 0] / some[:, 1]
    k = int(np.argmax(logits))
    return float(logits[k]) + bias, k


def softmax(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.table = model, TokenTable(model.figures)

    def logits(self, texts: list) -> np.ndarray:
        """Logit of each text's most toxic window; nan where a text has no word."""
        out = np.full(len(texts), np.nan)
        figures, starts = self.table.read(texts)
        full = figures[:, 1] > 0
        at = np.concatenate([[0], np.cumsum(full)])[starts]
        figures = figures[full]
        for k in range(len(texts)):
            if at[k] < at[k + 1]:
                out[k] = best_window(figures[at[k] : at[k + 1]], self.model.bias)[0]
        return out

    def scores(self, texts: list) -> np.ndarray:
        return np.nan_to_num(softmax(self.logits(texts)), nan=0.0)


def shrunk_odds(in_docs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where training starts from: each bucket's log odds between the classes, and the share of them (and of its steps) that counts.

    The share falls with the fourth power of what chance could make, but never to 0: a rare mark, or one of few labels, counts less.
    """
    p, n = (in_docs[1] + 0.5) / (docs[1] + 1), (in_docs[0] + 0.5) / (docs[0] + 1)
    both = (in_docs.sum(axis=0) + 1) / (docs.sum() + 2)
    z = (p - n) / np.sqrt(both * (1 - both) * (1 / max(1, docs[1]) + 1 / max(1, docs[0])))
    share = z**4 / (z**4 + CHANCE**4)
    return np.clip(np.log(p / n), -MOST, MOST) * share, share


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int | None = None) -> Model | None:
    """Fit both layers jointly; None unless both classes have words, and some n-gram enough documents."""
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in (text or "").split()], np.int64) for text in texts]
    token, bucket = bags(list(vocabulary))
    sizes = np.bincount(token, minlength=len(vocabulary))
    docs = [d[sizes[d] > 0] for d in docs]
    docs, y = [d for d in docs if len(d)], np.asarray([v for d, v in zip(docs, labels, strict=True) if len(d)], np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    by = np.argsort(token, kind="stable")
    token, bucket = token[by], bucket[by]
    first = np.searchsorted(token, np.arange(len(vocabulary) + 1))

    def entries(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the bags of some tokens, and which of the tokens each belongs to."""
        n = sizes[some]
        row = np.repeat(np.arange(len(some)), n)
        return first[some][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row], row

    in_docs = np.zeros((2, BUCKETS), np.int64)
    for words, label in zip(docs, y, strict=True):
        in_docs[label, np.unique(bucket[entries(np.unique(words))[0]])] += 1
    odds, evidence = shrunk_odds(in_docs, np.bincount(y, minlength=2))
    used = in_docs.sum(axis=0) >= LEAST_DOCS
    if not used.any():
        return None
    evidence = np.where(used, evidence, 0)[:, None].astype(np.float32)
    rng = np.random.default_rng(seed)
    along = np.full(DIM, DIM**-0.5, np.float32)
    e = (np.where(used, odds, 0)[:, None] * along + evidence * rng.normal(0, 0.01, (BUCKETS, DIM))).astype(np.float32)
    w = (GAIN * along[:, None] * np.array([-0.5, 0.5]) + rng.normal(0, 0.01, (DIM, 2))).astype(np.float32)
    b = np.zeros(2, np.float32)
    weight = (1 / (2 * np.bincount(y, minlength=2)[y]))[:, None].astype(np.float32)
    target = np.eye(2, dtype=np.float32)[y]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]
    at = np.arange(len(vocabulary))
    for step in range(1, (epochs or EPOCHS) + 1):
        model = Model(e, w, b)
        figures = np.stack([np.bincount(token, model.logit[bucket], len(at)), sizes], axis=1)
        windows = [d[k : k + WINDOW] for d in docs for k in [best_window(figures[d], 0.0)[1]]]
        n = np.fromiter(map(len, windows), np.int64, len(windows))
        flat, place = np.unique(np.concatenate(windows), return_inverse=True)
        of = np.repeat(np.arange(len(n)), n)
        where, row = entries(flat)
        held = bucket[where]
        vectors = np.add.reduceat(e[held], np.searchsorted(row, np.arange(len(flat))), axis=0)
        size = np.bincount(of, sizes[flat][place])[:, None].astype(np.float32)
        hidden = np.add.reduceat(vectors[place], np.cumsum(n) - n, axis=0) / size
        z = hidden @ w + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        dz = (p - target) * weight
        dh = (dz @ w.T / size).astype(np.float32)
        order = np.argsort(place, kind="stable")
        dtoken = np.add.reduceat(dh[of[order]], np.searchsorted(place[order], np.arange(len(flat))), axis=0)
        de = np.stack([np.bincount(held, dtoken[row, k], BUCKETS) for k in range(DIM)], axis=1).astype(np.float32)
        for k, (param, grad, rate) in enumerate(((e, de, evidence), (w, hidden.T @ dz, 1), (b, dz.sum(axis=0), 1))):
            m, v = state[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= RATE * rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Model(e, w, b)


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most SAMPLE_DOCS documents of each class, picked by a hash of their id.

    Held-out documents are never read. A document labelled more than once counts as toxic if any label is; of
    different texts with one id the first in order is taken.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = pick(known, "toxic", SAMPLE_DOCS)
    some = docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~held_out())
    rows = some.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id")
    found = [(row["text"], row["toxic"]) for row in rows.select("text", "toxic").toLocalIterator()]
    return [t for t, _ in found], [y for _, y in found]


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every text; one narrow pass, no shuffle."""
    some = docs.select("doc_id", held_out().alias("held_out"), "text")
    if model is None:
        return some.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    key = xxhash.xxh3_128_hexdigest(model.logit.tobytes())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        scorer = owned((Scorer, key), lambda: Scorer(shared.value))
        for batch in slices(batches):
            found = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return some.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
