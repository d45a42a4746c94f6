"""Benchmark decontamination by greedy string tiling.

Benchmark items are taken in blocks of bounded size, one at a time, each broadcast with the hashes of its runs of LEAST
words (its seeds). A document joins an item where they share such a run. For each joined pair the longest common runs
are found by Karp-Rabin hashing and marked as tiles, longest first, never overlapping, down to runs of
LEAST words; moved and reordered passages are tiles like others. The share of the item's words under tiles
is its coverage, and COVERAGE or more means that the document holds the item.

Defined cases: words are letters and digits in lower case; null and empty texts match nothing; an item of
fewer than LEAST words is held where all its words stand in one run; items and documents may be of any
length; an item that occurs twice is reported for each id; rows with the same doc_id are documents of
their own; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselake.llm.common import Shelf, gram_hashes, make_room, release, slices

#: Words of the shortest tile, share of an item's words under tiles, and UTF-8 bytes of items broadcast at once.
LEAST, COVERAGE, BLOCK_BYTES = 5, 0.6, 4 << 20

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def tile(a: list, b: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of a and b: (start in a, start in b, length), longest first, none overlapping.

    Lengths are tried by Karp-Rabin from the longest unmarked run down; a hash that agrees is compared word by
    word and extended to the end of the match.
    """
    marked_a, marked_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    number: dict = {}
    x = np.array([number.setdefault(w, len(number)) for w in a], np.uint64) + np.uint64(1)
    y = np.array([number.setdefault(w, len(number)) for w in b], np.uint64) + np.uint64(1)
    tiles = []

    def starts(hashes, marked, n):
        free = np.concatenate([[0], np.cumsum(marked)])
        return np.flatnonzero(free[n:] == free[:-n]) if len(hashes) else np.empty(0, np.int64)

    def common(n: int):
        """Places of unmarked runs of n words in both, as pairs (a, b)."""
        if n > min(len(a), len(b)):
            return []
        hx, hy = gram_hashes(x, n), gram_hashes(y, n)
        ax, by = starts(hx, marked_a, n), starts(hy, marked_b, n)
        order = ax[np.argsort(hx[ax], kind="stable")]
        ranked = hx[order]
        out = []
        low, high = np.searchsorted(ranked, hy[by], side="left"), np.searchsorted(ranked, hy[by], side="right")
        for j, lo, hi in zip(by.tolist(), low.tolist(), high.tolist(), strict=True):
            for i in order[lo:hi].tolist():
                if a[i : i + n] == b[j : j + n]:
                    out.append((i, j))
                    break  # the first free place in a; others are met again once this one is marked
        return out

    length = min(len(a), len(b))
    while length >= least:
        lo, hi = least, length  # the longest length that still matches, by halving
        if not common(lo):
            break
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        length = lo
        for i, j in common(length):
            if not (marked_a[i : i + length].any() or marked_b[j : j + length].any()):
                marked_a[i : i + length] = True
                marked_b[j : j + length] = True
                tiles.append((i, j, length))
    return tiles


class Items:
    """A block of items with the hashes of all their seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = [(n, words_of(t)) for n, t in items]
        self.words = [(n, w) for n, w in self.words if w]
        # words that no item has are 0: a run with one of them is no seed, and needs no hash
        self.hash = {w: xxhash.xxh3_64_intdigest(w) | 1 for _, words in self.words for w in words}
        seeds, owner = [], []
        self.short = {}
        for k, (_, words) in enumerate(self.words):
            if len(words) < LEAST:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(k)
                continue
            h = gram_hashes(np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words)), LEAST)
            seeds.append(h)
            owner.append(np.full(len(h), k))
        self.seeds = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        by = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owner = self.seeds[by], (np.concatenate(owner)[by] if owner else np.empty(0, np.int64))

    def held_in(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, words under tiles, tiles) of the items that a text holds."""
        words = words_of(text)
        out = []
        for n, known in self.short.items():
            found = {k for i in range(len(words) - n + 1) for k in known.get(tuple(words[i : i + n]), ())}
            out += [(self.words[k][0], 1.0, n, 1) for k in found]
        if len(words) >= LEAST and len(self.seeds):
            known = np.fromiter(map(self.hash.get, words, repeat(0)), np.uint64, len(words))
            run = np.convolve(known != 0, np.ones(LEAST, np.int64), "valid") == LEAST
            if not run.any():
                return sorted(out)
            h = gram_hashes(known, LEAST)
            low = np.searchsorted(self.seeds, h, side="left")
            high = np.where(run, np.searchsorted(self.seeds, h, side="right"), low)
            hits = np.flatnonzero(high > low)
            near: dict[int, list[int]] = {}
            for at in hits.tolist():
                for k in set(self.owner[low[at] : high[at]].tolist()):
                    near.setdefault(k, []).append(at)
            for k, places in near.items():
                item_id, item = self.words[k]
                # tiles lie in the runs of shared seeds, so the rest of a long document is left out
                seeds, parts, end = LEAST, [], -1
                for p in places:
                    if p > end:
                        parts += [None] * (end >= 0)  # a gap that no tile crosses
                        parts += words[p : p + seeds]
                    else:
                        parts += words[end : p + seeds]
                    end = p + seeds
                tiles = tile(item, parts)
                covered = sum(t[2] for t in tiles)
                if covered >= COVERAGE * len(item):
                    out.append((item_id, covered / len(item), covered, len(tiles)))
        return sorted(out)


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES):
    """Items in lists of at most ``size`` bytes (or one item); the driver holds one list at a time."""
    block, used = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator():
        n = len(row["text"].encode("utf-8", "surrogatepass"))
        if block and used + n > size:
            yield block
            block, used = [], 0
        block.append((row["item_id"], row["text"]))
        used += n
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, coverage double, words long, tiles long"


def _in_blocks(start: DataFrame, benchmark: DataFrame, block_bytes: int, name: str, step):
    """step(block) for each block of items. Where there are several, each is broadcast alone: its result is stored before the next."""
    make_room(start.sparkSession)
    shelf, before = None, None
    for block in blocks(benchmark, block_bytes):
        if before is not None:
            shelf = shelf or Shelf(start.sparkSession, name)
            yield from _stored(start, before, shelf, step)
        before = block
    if before is not None:
        if shelf is None:
            yield step(start.sparkSession.sparkContext.broadcast(before))
        else:
            yield from _stored(start, before, shelf, step)


def _stored(start: DataFrame, block, shelf: Shelf, step):
    shared = start.sparkSession.sparkContext.broadcast(block)
    yield shelf.put(step(shared), "block")
    shared.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, words, tiles of every item that a document holds; one narrow pass for each block."""
    spark = docs.sparkSession
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def one(shared) -> DataFrame:
        def find(batches):
            release()
            items = Items(shared.value)
            for batch in slices(batches):
                rows = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in items.held_in(t)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "words", "tiles"])

        return some.mapInArrow(find, SCHEMA)

    parts = list(_in_blocks(docs, benchmark, block_bytes, "contaminated", one))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, with all their columns, whatever their names; one narrow pass for each block of items."""
    left = docs

    def one(shared) -> DataFrame:
        def keep(batches):
            release()
            items = Items(shared.value)
            for batch in slices(batches):
                yield batch.filter(pa.array([not items.held_in(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        return left.mapInArrow(keep, docs.schema)

    for kept in _in_blocks(docs, benchmark, block_bytes, "clean", one):
        left = kept
    return left
