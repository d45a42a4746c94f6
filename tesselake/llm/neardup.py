"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF word shingles.

A document is the weighted set of its shingles of five words: how often each occurs, times 1 + ln(N/df) /
ln(N) for a shingle in df of N documents. Consistent weighted sampling draws HASHES shingles with their
quantised weights, so that two documents agree in a sample with the probability of their weighted Jaccard
similarity. ROWS samples make a band; documents that agree in a band are candidates, and a candidate is a
link only if its exact weighted Jaccard similarity is 0.8 or more. Classes are the links' components.

Groups of candidates are never paired up: equal texts are one candidate, and all of a group are first
compared with one member. Those outside the group's largest class by then are compared with the rest of the
group inside tasks of bounded size (at most LEFT by RIGHT members), which compare the samples drawn, verify
pairs of different classes that agree in LEAST_SAME or more of them, and emit only links that join classes.
A pair at 0.8 agrees in fewer with a probability of 0.00002.

Defined cases: a null text, and one without words, is alone in its class; a text of fewer than five
words is one shingle; equal texts share a class whatever their ids; rows with the same id and text are one
document; rows with one id but different texts are compared text by text, and the id joins their classes; rows without
an id are alone in a class whose id is null; an empty table gives an empty result; columns other than doc_id and text
are not read by ``near_duplicates`` and carried through by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselake.llm import grams
from tesselake.llm.common import GOLDEN, Shelf, make_room, mix64, own_name, release, slices

SHINGLE, SIMILARITY = 5, 0.8
#: 13 bands of 3: a pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** 3) ** 13 = 0.9999.
BANDS, ROWS = 13, 3
HASHES = BANDS * ROWS
#: Members of a group that a task compares with one another, and rows of a task of small groups.
LEFT, RIGHT, TASK_ROWS = 400, 800, 2000
LEAST_SAME = 20


class Shingles(grams.Bucket):
    """Shingles of a bucket; a shorter text is one shingle of all its words.

    48 bits tell shingles apart: two that agree by chance move a count or a similarity by next to nothing.
    """

    spare = 16

    def _grams(self) -> None:
        super()._grams()
        sizes = np.diff(self.starts)
        named = np.asarray(self.table.column("doc_id").is_valid())
        short = np.flatnonzero((sizes > 0) & (sizes < self.n) & named)
        if len(short):
            word_hashes = np.array(self.ids.hashes, np.uint64)
            extra = np.array([xxhash.xxh3_64_intdigest(word_hashes[self.words[self.starts[d] : self.starts[d + 1]]].tobytes(), 5) for d in short], np.uint64) >> np.uint64(self.spare) << np.uint64(self.spare)
            doc = np.concatenate([self.doc, short])
            by = np.argsort(doc, kind="stable")
            self.hashes, self.doc = np.concatenate([self.hashes, extra])[by], doc[by]

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, number of the shingle, how often) arrays, by document and then shingle; ``values`` has the shingles by number."""
        self.distinct()
        column = np.empty(len(self.hashes), np.int64)
        column[self.order] = np.repeat(np.arange(len(self.values)), np.diff(np.append(self.firsts, len(self.order))))
        pair = np.sort(self.doc * len(self.values) + column) if len(column) else column
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(pair)))
        doc, column = np.divmod(pair[at], max(1, len(self.values)))
        return doc, column, tf

    def known(self, answers: pa.Table, groups: int) -> np.ndarray:
        """Documents of the corpus that hold each of the shingles, by number, from what the index answers."""
        df = np.ones(len(self.values), np.uint32)
        starts = grams.group_starts(self.values, groups)
        for r, blob in zip(answers.column("r").to_pylist(), answers.column("df").to_pylist(), strict=True):
            df[starts[r] : starts[r + 1]] = np.frombuffer(zlib.decompress(blob), np.uint32)
        return df


def weights_of(tf: np.ndarray, df: np.ndarray, n_docs: int) -> np.ndarray:
    """How often a shingle occurs, times 1 + ln(N/df) / ln(N)."""
    return (tf * (1 + np.log(max(1, n_docs) / df) / np.log(max(2, n_docs)))).astype(np.float32)


def _packed(df: np.ndarray) -> bytes:
    """Counts of a document's shingles; empty where each is 1, as it is in most."""
    return zlib.compress(df.tobytes(), 1) if (df != 1).any() else b""


def _answer(table: pa.Table) -> pa.Table:
    """The number of documents of the whole corpus that hold each of a bucket's shingles, in the bucket's order."""
    release()
    table, buckets, sizes, order, firsts, lengths, _, _ = grams.meet(table)
    held = np.concatenate([np.frombuffer(zlib.decompress(d), np.uint32) for d in table.column("docs").to_pylist()]).astype(np.int64)
    total = np.repeat(np.add.reduceat(held[order], firsts), lengths)
    df = np.empty(len(held), np.uint32)
    df[order] = np.minimum(total, 2**32 - 1)
    cuts = np.append(0, np.cumsum(sizes))
    blobs = [zlib.compress(df[i:j].tobytes(), 1) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([pa.array(buckets, pa.int32()), table.column("r"), pa.array(blobs, pa.binary())], names=["b", "r", "df"])


def _gamma_table(steps: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of equal steps."""
    x = np.concatenate([np.linspace(0, 0.05, 20_000), np.linspace(0.05, 30, 200_000)[1:]])
    return np.interp((np.arange(steps) + 0.5) / steps, 1 - np.exp(-x) * (1 + x), x)


_GAMMA = _gamma_table()
_R, _ONE_BY_R, _LOG_C = (x.astype(np.float32) for x in (_GAMMA, 1 / _GAMMA, np.log(_GAMMA)))
_BETA = (np.arange(1 << 16) / (1 << 16)).astype(np.float32)
#: Shingles that are drawn from at once: few enough for the arrays to stay in a processor's cache.
BLOCK = 1 << 14


def samples(doc: np.ndarray, shingles: np.ndarray, weights: np.ndarray, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Consistent weighted samples: (documents with shingles, an array of documents x hashes).

    For each hash a shingle has its own r and c from Gamma(2, 1) and beta from [0, 1), all from its bits;
    t = floor(ln(w) / r + beta), ln(y) = r (t - beta), and the shingle with the least ln(c) - ln(y) - r is
    drawn, together with t.
    """
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    starts = np.append(np.flatnonzero(new), len(doc))
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(doc), BLOCK)), len(starts) - 1))
    drawn = [_draw(shingles[starts[i] : starts[j]], weights[starts[i] : starts[j]], starts[i:j] - starts[i], hashes) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return doc[starts[:-1]], np.concatenate(drawn) if drawn else np.empty((0, hashes), np.uint64)


def _draw(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    sizes = np.diff(np.append(starts, len(shingles)))
    out = np.empty((len(starts), hashes), np.uint64)
    log_w = np.log(weights, dtype=np.float32)
    for k in range(hashes):
        bits = mix64(shingles + np.uint64((k + 1) * int(GOLDEN) % 2**64)).view(np.uint16).reshape(-1, 4)
        beta = _BETA[bits[:, 2]]
        t = np.floor(log_w * _ONE_BY_R[bits[:, 0]] + beta)
        least = _LOG_C[bits[:, 1]] - (t - beta + 1) * _R[bits[:, 0]]
        hit = np.flatnonzero(least == np.repeat(np.minimum.reduceat(least, starts), sizes))
        first = hit[np.searchsorted(hit, starts)]
        out[:, k] = mix64(shingles[first] + t[first].astype(np.int64).view(np.uint64) * GOLDEN)
    return out


def _sketch(n_docs: int, groups: int):
    kinds = {"doc_id": pa.int64(), "same": pa.binary(), "keys": pa.list_(pa.int64()), "drawn": pa.binary(), "df": pa.binary()}

    def sketch(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Per document: its id, a hash of its text, one key a band, the samples, and the counts of its shingles."""
        release()
        if docs.num_rows == 0:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        bucket = Shingles(docs, SHINGLE, lower=True)
        doc, column, tf = bucket.counted()
        df = bucket.known(answers, groups)[column]
        rows, drawn = samples(doc, bucket.values[column], weights_of(tf, df, n_docs))
        keys = np.zeros((len(rows), BANDS), np.uint64)
        for j in range(ROWS):
            keys = mix64(keys * GOLDEN + drawn[:, j::ROWS][:, :BANDS])
        same = [xxhash.xxh3_128_digest(bucket.texts[d].encode("utf-8", "surrogatepass")) for d in rows]
        ids = bucket.table.column("doc_id").take(pa.array(rows))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel()))
        short = [x.tobytes() for x in (drawn & np.uint64(0xFFFFFFFF)).astype(np.uint32)]
        cuts = np.append(np.searchsorted(doc, rows), len(doc))
        counts = [_packed(df[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([ids, pa.array(same, pa.binary()), flat, pa.array(short, pa.binary()), pa.array(counts, pa.binary())], names=list(kinds))

    return sketch


def _vectors(n_docs: int):
    def vectors(batches):
        """The weighted shingles of documents, sorted, as two packed arrays."""
        release()
        for batch in slices(batches):
            bucket = Shingles(pa.Table.from_batches([batch]), SHINGLE, lower=True)
            doc, column, tf = bucket.counted()
            shingles = bucket.values[column]
            cuts = np.searchsorted(doc, np.arange(len(bucket.texts) + 1))
            columns: list[list] = [[], []]
            for blob, i, j in zip(bucket.table.column("df").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                df = np.frombuffer(zlib.decompress(blob), np.uint32) if blob else np.ones(j - i, np.uint32)
                columns[0].append(shingles[i:j].tobytes())
                columns[1].append(weights_of(tf[i:j], df, n_docs).tobytes())
            yield pa.RecordBatch.from_arrays([bucket.table.column("doc_id").combine_chunks(), *(pa.array(c, pa.binary()) for c in columns)], names=["doc_id", "shingles", "weights"])

    return vectors


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the smaller weights over the sum of the larger ones; shingles are sorted and distinct."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a
    shared = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return shared / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - shared)


def _verify(threshold: float):
    def verify(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("s1", "w1", "s2", "w2")]
            similar = [weighted_jaccard(np.frombuffer(a, np.uint64), np.frombuffer(x, np.float32), np.frombuffer(b, np.uint64), np.frombuffer(y, np.float32)) for a, x, b, y in zip(*columns, strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(similar, pa.float64())], names=["u", "v", "similarity"])
            yield out.filter(pc.greater_equal(out.column("similarity"), threshold))

    return verify


def _joins(threshold: float):
    """Compares the members of cells; emits the links that join two classes."""

    def joins(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        sides = [{k: t.column(k).to_pylist() for k in ("cell", "doc_id", "class_id", "shingles", "weights")} | {"drawn": np.frombuffer(b"".join(t.column("drawn").to_pylist()), np.uint32).reshape(-1, HASHES)} for t in (left, right)]
        one, two = sides
        in_cell: dict[str, list[int]] = {}
        for j, cell in enumerate(two["cell"]):
            in_cell.setdefault(cell, []).append(j)
        for i, cell in enumerate(one["cell"]):
            others = np.array(in_cell.get(cell, ()), np.int64)
            if not len(others):
                continue
            near = others[(two["drawn"][others] == one["drawn"][i]).sum(axis=1) >= LEAST_SAME]
            a, wa = np.frombuffer(one["shingles"][i], np.uint64), np.frombuffer(one["weights"][i], np.float32)
            for j in near.tolist():
                x, y = root(one["class_id"][i]), root(two["class_id"][j])
                if x != y:
                    similar = weighted_jaccard(a, wa, np.frombuffer(two["shingles"][j], np.uint64), np.frombuffer(two["weights"][j], np.float32))
                    if similar >= threshold:
                        parent[max(x, y)] = min(x, y)
                        found.append((one["doc_id"][i], two["doc_id"][j], similar))
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["u", "v", "similarity"])

    return joins


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """doc_id, class_id (the smallest id) of each document with a link: labels fall along links and jump to their own label's label."""
    edges = shelf.put(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = shelf.put(edges.groupBy(F.col("u").alias("doc_id")).agg(F.least(F.min("v"), F.col("u")).alias("class_id"), F.lit(True).alias("changed")), "labels")
    while not labels.where("changed").isEmpty():
        near = edges.join(labels, edges.v == labels.doc_id).groupBy(F.col("u").alias("doc_id")).agg(F.min("class_id").alias("near"))
        jump = labels.select(F.col("doc_id").alias("class_id"), F.col("class_id").alias("jump"))
        fallen = labels.drop("changed").join(near, "doc_id").join(jump, "class_id").select("doc_id", F.least("near", "jump", "class_id").alias("class_id"), (F.least("near", "jump") < F.col("class_id")).alias("changed"))
        before, labels = labels, shelf.put(fallen, "labels")
        shelf.drop(before)
    shelf.drop(edges)
    return labels


def _classes(docs: DataFrame, threshold: float, bucket_bytes: int, shelf: Shelf) -> DataFrame:
    """doc_id and class_id (null where the document is alone) of the ids that have a class or a copy; an id is on one row."""
    some = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    make_room(docs.sparkSession)
    plan = grams.plan(some, bucket_bytes)
    dealt = some.withColumn("b", plan.bucket())
    answers = shelf.put(grams.blobs(dealt, SHINGLE, plan.groups, lower=True, counts=True, bucket=Shingles).groupBy("r").applyInArrow(_answer, "b int, r int, df binary"), "df")
    found = dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(_sketch(plan.docs, plan.groups), "doc_id long, same binary, keys array<long>, drawn binary, df binary")
    sketches = shelf.put(found, "sketches")
    shelf.drop(answers)
    # equal texts are one candidate: the first of them stands for all
    first = shelf.put(sketches.groupBy("same").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "rep"), "first")
    copies = shelf.put(sketches.select("doc_id", "same").join(first, "same").select("doc_id", "rep"), "copies")
    reps = sketches.join(copies.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    keys = reps.select("doc_id", F.posexplode("keys").alias("band", "key"))
    met = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("main")).where("n > 1")
    members = shelf.put(keys.join(met, ["band", "key"]).select(F.xxhash64("band", "key").alias("g"), "doc_id", "main"), "members")
    # of the texts only the candidates' are read again, with the counts that came with their sketches
    wanted = sketches.select("doc_id", "df").join(members.select("doc_id").distinct(), "doc_id")
    vectors = shelf.put(some.join(wanted, "doc_id").mapInArrow(_vectors(plan.docs), "doc_id long, shingles binary, weights binary"), "vectors")

    def verified(pairs: DataFrame) -> DataFrame:
        one = vectors.select(F.col("doc_id").alias("u"), F.col("shingles").alias("s1"), F.col("weights").alias("w1"))
        two = vectors.select(F.col("doc_id").alias("v"), F.col("shingles").alias("s2"), F.col("weights").alias("w2"))
        return pairs.join(one, "u").join(two, "v").mapInArrow(_verify(threshold), "u long, v long, similarity double")

    links = shelf.put(verified(members.where("doc_id <> main").select(F.col("doc_id").alias("u"), F.col("main").alias("v")).distinct()), "links")
    classes = components(links, shelf)
    named = shelf.put(members.select("g", "doc_id").join(classes.select("doc_id", "class_id"), "doc_id", "left").select("g", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")), "named")
    shelf.drop(members)
    sizes = named.groupBy("g", "class_id").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("g").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class_id")).alias("top")).where("top.n < n")
    open_ = open_.select("g", F.col("top.class_id").alias("most"), F.ceil((F.col("n") - F.col("top.n")) / LEFT).cast("int").alias("lefts"), F.ceil(F.col("n") / RIGHT).cast("int").alias("rights"))
    rest = shelf.put(named.join(open_, "g"), "open")
    n_tasks = max(1, rest.count() // TASK_ROWS)
    part = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.where("class_id <> most").withColumn("i", part(1, "lefts")).withColumn("j", each("rights"))
    right = rest.withColumn("j", part(2, "rights")).withColumn("i", each("lefts"))

    def cells(side: DataFrame) -> DataFrame:
        side = side.select("doc_id", "class_id", F.concat_ws(" ", "g", "i", "j").alias("cell"))
        side = side.join(vectors, "doc_id").join(sketches.select("doc_id", "drawn"), "doc_id")
        # a cell of a large group is a task's work alone; those of small groups share one
        own = [F.col(c).alias(c) for c in ("doc_id", "class_id", "cell", "shingles", "weights", "drawn")]  # so that the sides share no column
        return side.select(*own, F.pmod(F.xxhash64("cell"), F.lit(n_tasks)).alias("task"))

    more = cells(left).groupBy("task").cogroup(cells(right).groupBy("task")).applyInArrow(_joins(threshold), "u long, v long, similarity double")
    more = shelf.put(more, "links")
    if not more.isEmpty():
        classes = components(links.unionByName(more), shelf)
    labels = classes.select(F.col("doc_id").alias("rep"), "class_id")
    through = copies.join(labels, "rep", "left").select("doc_id", F.coalesce("class_id", "rep").alias("class_id"))
    alone = labels.join(copies.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("doc_id"), "class_id")
    out = shelf.put(through.unionByName(alone), "classes")
    shelf.keep(out)
    return out


def _repeated(docs: DataFrame) -> tuple[bool, bool]:
    """Whether any id is on several rows, and whether any is with different texts."""
    text = F.xxhash64("text", F.col("text").isNull())
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("low"), F.max(text).alias("high"))
    row = ids.agg(F.max(F.col("n") > 1).alias("rows"), F.max(F.col("low") < F.col("high")).alias("texts")).first()
    return bool(row["rows"]), bool(row["texts"])


def _node():
    """A number for an id and text; null without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text", F.col("text").isNull()))


def _text_classes(docs: DataFrame, threshold: float, bucket_bytes: int, shelf: Shelf) -> DataFrame:
    """doc_id, node, same: each text of each id, judged by itself, and its class among the nodes."""
    nodes = docs.select("doc_id", _node().alias("node"), "text").where("node is not null").dropDuplicates(["node"])
    found = _classes(nodes.select(F.col("node").alias("doc_id"), "text"), threshold, bucket_bytes, shelf)
    out = shelf.put(nodes.select("doc_id", "node").join(found.select(F.col("doc_id").alias("node"), F.col("class_id").alias("same")), "node", "left").select("doc_id", "node", F.coalesce("same", "node").alias("same")), "texts")
    shelf.keep(out)
    return out


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bucket_bytes: int = grams.BUCKET_BYTES) -> DataFrame:
    """doc_id and class_id of every document: the smallest id of its near and exact copies."""
    shelf = Shelf(docs.sparkSession, "near-duplicates")
    rows, texts = _repeated(docs)
    ids = docs.select("doc_id")
    if not texts:
        one = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]) if rows else docs
        return ids.join(_classes(one, threshold, bucket_bytes, shelf), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    found = _text_classes(docs, threshold, bucket_bytes, shelf)
    # an id joins the classes of its texts
    least = found.groupBy("doc_id").agg(F.min("same").alias("v"))
    labels = components(found.select("doc_id", F.col("same").alias("u")).join(least, "doc_id").where("u <> v").select("u", "v"), shelf)
    joined = least.join(labels.select(F.col("doc_id").alias("v"), F.col("class_id").alias("label")), "v", "left").select("doc_id", F.coalesce("label", "v").alias("label"))
    named = joined.join(joined.groupBy("label").agg(F.min("doc_id").alias("class_id")), "label").select("doc_id", "class_id")
    return ids.join(named, "doc_id", "left")


def one_of_each(docs: DataFrame, threshold: float = SIMILARITY, bucket_bytes: int = grams.BUCKET_BYTES) -> DataFrame:
    """The documents that are the first of their class, with all their columns; those without an id stay.

    Each row is judged by its own text: where rows of an id have different texts, each class of texts keeps the
    one with the smallest id (then number of id and text). Of rows with the same id and text the one with the
    smallest hash of all columns stays.
    """
    shelf = Shelf(docs.sparkSession, "one-of-each")
    rows, texts = _repeated(docs)
    if texts:
        found = _text_classes(docs, threshold, bucket_bytes, shelf)
        first = found.groupBy("same").agg(F.min(F.struct("doc_id", "node")).alias("first")).select(F.col("first.node").alias("node"))
        mark = own_name(docs, "node")
        kept = docs.withColumn(mark, _node()).join(first.withColumnRenamed("node", mark), mark, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    else:
        one = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]) if rows else docs
        gone = _classes(one, threshold, bucket_bytes, shelf).where("doc_id <> class_id").select("doc_id")
        kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not rows:
        return kept
    one = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(F.xxhash64(*docs.columns).alias("h"), F.struct(*docs.columns).alias("row"))).alias("one"))
    return one.select("one.row.*").unionByName(kept.where("doc_id is null"))
