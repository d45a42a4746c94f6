"""An exact index of all word n-grams of a corpus that never holds a row for each n-gram.

Documents are dealt into buckets of consecutive ids and bounded bytes. A bucket's distinct n-gram hashes
are sorted and cut by their leading bits into one packed blob for each index group; a group meets the
blobs of all buckets, so an n-gram weighs at most one entry a bucket however many documents repeat it,
and answers each bucket about its own entries in their order. What crosses the network is a few bytes for
each distinct n-gram of a bucket, and answers about those that other buckets share.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselake.llm.common import WordIds, flat_words, gram_hashes, gram_places, release

#: Text bytes of a bucket and n-grams of an index group: what one task holds at a time.
BUCKET_BYTES, GROUP_GRAMS = 6 << 20, 1 << 21
#: Quantiles of the ids that the buckets follow; between two of them ids are cut evenly.
QUANTILES = 512


@dataclass
class Plan:
    """``edges``: ids at which the intervals of buckets start, rising; ``last``: the last id; ``parts``: buckets of each interval; ``heavy``: buckets
    in front of each interval that the rows of its first id alone are dealt to, if that id has more than a bucket holds."""

    docs: int
    buckets: int
    groups: int
    edges: list[int]
    last: int
    parts: int
    heavy: list[int]

    def bucket(self, col: str = "doc_id", text: str = "text") -> Column:
        """Bucket number, not falling as the id grows; rows without an id, and those of one heavy id, are dealt by their text."""
        x, by_text = F.col(col), F.pmod(F.xxhash64(text), F.lit(1 << 30))
        number = lambda values: F.array(*(F.lit(v) for v in values))
        at = F.greatest(F.size(F.filter(number(self.edges), lambda e: e <= x)), F.lit(1))  # no id is below all edges, as they are ids
        first = F.element_at(number([sum(self.heavy[:k]) + k * self.parts for k in range(len(self.edges))]), at)
        low, heavy = F.element_at(number(self.edges), at), F.element_at(number(self.heavy), at)
        start, end = F.element_at(number(map(float, self.edges)), at), F.element_at(number([*map(float, self.edges[1:]), self.last + 1.0]), at)
        share = F.least(F.lit(self.parts - 1.0), F.floor((x.cast("double") - start) / F.greatest(end - start, F.lit(1.0)) * self.parts)).cast("int")
        dealt = F.when((heavy > 0) & (x == low), F.pmod(by_text, F.greatest(heavy, F.lit(1)))).otherwise(heavy + F.greatest(F.lit(0), share))
        return F.when(x.isNull(), F.pmod(by_text, F.lit(self.buckets))).otherwise(first + dealt).cast("int").alias("b")


def plan(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, group_grams: int = GROUP_GRAMS) -> Plan:
    """Sizes the index by one aggregation over ids and lengths. An id that fills several quantiles is a heavy one."""
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"), F.percentile_approx("doc_id", at, 10 * QUANTILES).alias("edges")).first()
    wanted = max(1, -(-row["size"] // bucket_bytes))
    parts, step = -(-wanted // QUANTILES), max(1, QUANTILES // wanted)
    seen = Counter(row["edges"] or [0])
    heavy = {e: -(-n * wanted // QUANTILES) for e, n in seen.items() if n > 1 and n * wanted >= 2 * QUANTILES}
    edges = sorted({*sorted(seen)[::step], *heavy})
    extra = [heavy.get(e, 0) for e in edges]
    return Plan(row["n"], len(edges) * parts + sum(extra), max(1, -(-row["size"] // 6 // group_grams)), edges, max(seen), parts, extra)


class Bucket:
    """The words and n-grams of one bucket's documents, in the order of their ids; null ids come last."""

    #: Trailing bits of a hash that the index leaves out.
    spare = 0

    def __init__(self, table: pa.Table, n: int, lower: bool = False):
        self.table = table.sort_by([("doc_id", "ascending")])
        self.ids = WordIds()
        self.texts = self.table.column("text").to_pylist()
        self.words, self.starts = flat_words(self.texts, self.ids, lower)
        self.n = n
        self._grams()

    def _grams(self) -> None:
        hashes = np.array(self.ids.hashes, np.uint64)
        all_grams = gram_hashes(hashes[self.words] if len(self.words) else np.empty(0, np.uint64), self.n)
        self.places = np.flatnonzero(gram_places(self.starts, self.n, len(self.words)))
        named = int(np.count_nonzero(np.asarray(self.table.column("doc_id").is_valid())))
        self.places = self.places[self.places < self.starts[named]]  # documents without an id take no part
        self.hashes = all_grams[self.places] >> np.uint64(self.spare) << np.uint64(self.spare)
        self.doc = np.searchsorted(self.starts, self.places, side="right") - 1

    def distinct(self) -> None:
        """Sorts the n-grams: ``order`` (stable, so by document), ``firsts`` in it, ``values``."""
        self.order = np.argsort(self.hashes, kind="stable")
        ranked = self.hashes[self.order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.firsts = np.flatnonzero(new)
        self.values = ranked[self.firsts]

    def docs_with(self) -> np.ndarray:
        """Documents of the bucket that hold each distinct n-gram."""
        doc = self.doc[self.order]
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        new[self.firsts] = True
        return np.add.reduceat(new.astype(np.int64), self.firsts) if len(new) else np.empty(0, np.int64)


def group_starts(values: np.ndarray, groups: int) -> np.ndarray:
    """Where each group's values start in a sorted array (and its length): groups go by the leading 32 bits."""
    group = ((values >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    return np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as a first value and differences of as many bytes as the largest needs; common zero bytes at their ends are left out."""
    all_bits = int(np.bitwise_or.reduce(values)) if len(values) else 0
    shift = 16 if all_bits and all_bits & 0xFFFF == 0 else 0
    steps = np.diff(values) >> np.uint64(shift)
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 1
    return bytes([width, shift]) + values[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    first = np.frombuffer(blob, np.uint64, 1, 2)
    raw = np.frombuffer(blob, np.uint8, offset=10).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.concatenate([first, first[0] + np.cumsum(steps.view(np.uint64).ravel() << np.uint64(blob[1]), dtype=np.uint64)])


BLOBS = "r int, b int, grams binary, docs binary"


def blobs(docs: DataFrame, n: int, groups: int, lower: bool = False, counts: bool = False, bucket: type = Bucket) -> DataFrame:
    """One row for each bucket and group: the bucket's distinct n-grams, and how many documents hold each."""

    def pack_bucket(table: pa.Table) -> pa.Table:
        release()
        held_by = bucket(table, n, lower)
        held_by.distinct()
        starts = group_starts(held_by.values, groups)
        held = held_by.docs_with() if counts else None
        rows = []
        for r in np.flatnonzero(np.diff(starts)):
            some = slice(starts[r], starts[r + 1])
            rows.append((int(r), table.column("b")[0].as_py(), pack(held_by.values[some]), zlib.compress(held[some].astype(np.uint32).tobytes(), 1) if counts else None))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["r", "b", "grams", "docs"])

    return docs.groupBy("b").applyInArrow(pack_bucket, BLOBS)


def meet(table: pa.Table):
    """All entries of a group, by value and then bucket: (buckets in order, entry order, run starts, run lengths, owner, place)."""
    table = table.sort_by([("b", "ascending")])
    buckets = table.column("b").to_pylist()
    parts = [unpack(x) for x in table.column("grams").to_pylist()]
    sizes = [len(p) for p in parts]
    values = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    place = np.concatenate([np.arange(s, dtype=np.uint32) for s in sizes])
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    firsts = np.flatnonzero(new)
    lengths = np.diff(np.append(firsts, len(ranked)))
    return table, buckets, sizes, order, firsts, lengths, owner, place
