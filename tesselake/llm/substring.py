"""Substring deduplication by suffix automata of reference shards.

A document's words go where a window of WINDOW words also starts in an earlier document. Reference shards can't
be broadcast within a bound that holds for any corpus, so the index and the automata share the work like this.
The window index of :mod:`tesselake.llm.grams` (64-bit hashes) decides which passages can be references at all: for
each window that several buckets of documents share it finds the bucket of its first document, and that bucket
sends the passages (each once, with its document's id) to the buckets that repeat them. The automaton decides what
goes: a bucket builds one suffix automaton of the passages it was sent and of those its own documents repeat,
with the earliest document of each state, and streams the runs of words that hold a known window through it;
matching statistics of the window's length or more, in an earlier document, mark the maximal spans that are removed.
So each automaton holds just the references that its bucket can match, whatever the corpus holds.

Defined cases: a null or empty text has no words and stays null or empty; documents without an id are
kept whole and are no reference; rows with the same id are one another's equals, so neither removes from
the other, and many rows of one id are dealt to several buckets by their texts; a text may be of any length; an empty
table gives an empty result; other columns, whatever their names, are carried along, but ``remove_repeats`` puts its
own n_words and n_removed in place of columns of these names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselake.llm import grams
from tesselake.llm.automaton import SuffixAutomaton
from tesselake.llm.common import gram_hashes, make_room, own_name, release

WINDOW = 13


def _owners(window_buckets: pa.Table) -> pa.Table:
    """Tells the first bucket of each shared window which others repeat it."""
    release()
    table, buckets, sizes, order, firsts, lengths, owner, place = grams.meet(window_buckets)
    shared = lengths > 1
    start, more = firsts[shared], lengths[shared] - 1
    at = np.repeat(start, more)
    others = order[at + 1 + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))]
    mine = order[at]
    rows = []
    by = np.argsort(owner[mine], kind="stable")
    cuts = np.searchsorted(owner[mine][by], np.arange(len(buckets) + 1))
    names = np.array(buckets, np.int32)
    r = table.column("r")[0].as_py()
    for k in np.flatnonzero(np.diff(cuts)):
        some = by[cuts[k] : cuts[k + 1]]
        rows.append((buckets[k], r, zlib.compress(place[mine[some]].tobytes(), 1), zlib.compress(names[owner[others[some]]].tobytes(), 1)))
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["b", "r", "place", "dest"])


def _send(window: int, groups: int):
    def send(docs: pa.Table, asked: pa.Table) -> pa.Table:
        """The passages that other buckets repeat, each after its document's id, one row for each of those buckets."""
        release()
        out: dict[int, list[bytes]] = {}
        if docs.num_rows and asked.num_rows:
            bucket = grams.Bucket(docs, window)
            bucket.distinct()
            starts = grams.group_starts(bucket.values, groups)
            place = np.concatenate([starts[r] + np.frombuffer(zlib.decompress(p), np.uint32).astype(np.int64) for r, p in zip(asked.column("r").to_pylist(), asked.column("place").to_pylist(), strict=True)])
            dest = np.concatenate([np.frombuffer(zlib.decompress(d), np.int32) for d in asked.column("dest").to_pylist()])
            at = bucket.places[bucket.order[bucket.firsts[place]]]  # stable order: in the first document
            by = np.lexsort((at, dest))
            at, dest = at[by], dest[by]
            breaks = np.flatnonzero(np.append(True, (dest[1:] != dest[:-1]) | (at[1:] != at[:-1] + 1)))
            ends = np.append(breaks[1:], len(at)) - 1
            names, ids = list(bucket.ids), bucket.table.column("doc_id").to_pylist()
            for i, j in zip(breaks, ends, strict=True):
                words = bucket.words[at[i] : at[j] + window].tolist()
                owner = ids[np.searchsorted(bucket.starts, at[i], side="right") - 1]
                out.setdefault(int(dest[i]), []).append(b"%d " % owner + b" ".join([names[w] for w in words]))
        return pa.table([pa.array(list(out), pa.int32()), pa.array([b"\n".join(x) for x in out.values()], pa.binary())], names=["b", "passages"])

    return send


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive numbers, as (first, last)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True))


def removed_words(bucket: grams.Bucket, passages: list[list[bytes]], owners: list[int], window: int) -> np.ndarray:
    """Marks the words of a bucket to remove: the automaton's matches among the windows that can match; ids are ranks."""
    rank_of = bucket.table.column("doc_id").fill_null(0).to_numpy()  # those without an id have no windows
    sent = [np.fromiter(map(bucket.ids.__getitem__, p), np.int64, len(p)) for p in passages]
    hashes = np.array(bucket.ids.hashes, np.uint64)
    bucket.distinct()
    foreign = np.concatenate([gram_hashes(hashes[s], window) for s in sent]) if sent else np.empty(0, np.uint64)
    foreign.sort()
    known = np.zeros(len(bucket.values), bool)
    if len(foreign):
        at = np.minimum(np.searchsorted(foreign, bucket.values), len(foreign) - 1)
        known = foreign[at] == bucket.values
    gone = np.zeros(len(bucket.words), bool)
    if not len(bucket.values):
        return gone
    rank = rank_of[bucket.doc[bucket.order]]
    lowest, highest = rank[bucket.firsts], np.maximum.reduceat(rank, bucket.firsts)
    inside = lowest != highest
    # the passages that the bucket's own documents repeat, from the first of them
    references = [(bucket.words[i : j + window].tolist(), int(rank_of[np.searchsorted(bucket.starts, i, side="right") - 1])) for i, j in _runs(np.sort(bucket.places[bucket.order[bucket.firsts[inside]]]))]
    maybe = np.zeros(len(bucket.hashes), bool)
    maybe[bucket.order] = np.repeat(known | inside, np.diff(np.append(bucket.firsts, len(bucket.order))))
    if not maybe.any():
        return gone
    automaton = SuffixAutomaton([*(s.tolist() for s in sent), *(words for words, _ in references)], [*owners, *(rank for _, rank in references)])
    for i, j in _runs(bucket.places[maybe]):
        doc = int(np.searchsorted(bucket.starts, i, side="right") - 1)
        ends = automaton.matches(bucket.words[i : j + window].tolist(), window, int(rank_of[doc]))
        for first, last in _runs(np.array(ends, np.int64)):
            gone[i + first - window + 1 : i + last + 1] = True
    return gone


def _remove(window: int, names: list[str]):
    def remove(docs: pa.Table, sent: pa.Table) -> pa.Table:
        release()
        *given, _ = docs.column_names  # the user's columns under working names, then the bucket
        bucket = grams.Bucket(docs, window)
        passages = [p.split(b" ") for row in sent.column("passages").to_pylist() for p in row.split(b"\n")]
        gone = removed_words(bucket, [p[1:] for p in passages], [int(p[0]) for p in passages], window)
        texts, n_words, n_removed = [], [], []
        by_id = list(bucket.ids)
        for k, text in enumerate(bucket.texts):
            here = gone[bucket.starts[k] : bucket.starts[k + 1]]
            n = int(here.sum())
            n_words.append(len(here))
            n_removed.append(n)
            if n:
                kept = bucket.words[bucket.starts[k] : bucket.starts[k + 1]][~here].tolist()
                text = b" ".join([by_id[w] for w in kept]).decode("utf-8", "surrogatepass")
            texts.append(text)
        kinds = {"text": pa.array(texts, pa.string())}
        columns = [kinds.get(c, bucket.table.column(c)) for c in given]
        return pa.table([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=names)

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = grams.BUCKET_BYTES) -> DataFrame:
    """All columns of docs with the kept text (unchanged where nothing was removed), n_words and n_removed."""
    docs = docs.select(*(c for c in docs.columns if c not in ("n_words", "n_removed")))
    given = docs.schema
    # working names, so that no column of the user's clashes with one of the steps'
    some = docs.toDF(*(c if c in ("doc_id", "text") else f"user{k}" for k, c in enumerate(docs.columns)))
    make_room(docs.sparkSession)
    plan = grams.plan(some, bucket_bytes)
    dealt = some.withColumn("b", plan.bucket())
    texts = dealt.select("doc_id", "text", "b")
    asked = grams.blobs(texts, window, plan.groups).groupBy("r").applyInArrow(_owners, "b int, r int, place binary, dest binary")
    sent = texts.groupBy("b").cogroup(asked.groupBy("b")).applyInArrow(_send(window, plan.groups), "b int, passages binary")
    names = [*some.columns, "n_words", "n_removed"]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(some.columns, given.fields, strict=True)]).add("n_words", "long").add("n_removed", "long")
    out = dealt.groupBy("b").cogroup(sent.groupBy("b")).applyInArrow(_remove(window, names), schema)
    return out.toDF(*given.names, "n_words", "n_removed")


def kept_words(text: str = "text"):
    """The words of a text joined by one space: removal leaves just that, an untouched text is brought to it."""
    cut = F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " ")
    return F.coalesce(F.regexp_replace(cut, r"^ | $", ""), F.lit(""))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The columns of docs, whatever their names, with the kept text, and its length in n_chars where there is such a column."""
    names = [own_name(docs, f"kept_{c}") if c in ("n_words", "n_removed") else c for c in docs.columns]
    out = remove_repeats(docs.toDF(*names), window).select(*names).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
