"""Helpers that the operators share: tables, materialised steps, what workers keep, words and 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only on one machine whose session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; our own in local mode alone, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or FALLBACK_DIR).rstrip('/')}/tesselake"


class Shelf:
    """Parquet tables in the shared folder that cut the lineage of a job's steps, so that a lost executor costs one step.

    A table goes when ``drop`` or ``keep`` says that nothing reads it any more; those that the job's result
    still reads go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.dir)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(path)  # only what is there can be marked
        self.files.deleteOnExit(path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """The rows of df, read from a new table.

        The shuffle files of the steps behind it are of no use any more; Spark drops them when their
        plan objects are collected, so both garbage collectors are asked to run.
        """
        path = f"{self.dir}/{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(path)
        del df
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        out = self.spark.read.schema(schema).parquet(path)
        self.tables.append((out, path))
        return out

    def drop(self, *gone: DataFrame) -> None:
        for df, path in self.tables:
            if any(df is x for x in gone):
                self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        self.tables = [(df, path) for df, path in self.tables if not any(df is x for x in gone)]

    def keep(self, *kept: DataFrame) -> None:
        """Drops all tables but these."""
        self.drop(*(df for df, _ in self.tables if not any(df is x for x in kept)))


def make_room(spark: SparkSession) -> None:
    """Asks the executors' JVMs to collect their garbage: after a full collection a heap that earlier steps have filled shrinks
    to what is in use, and the Python workers of the next step have the room."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def own_name(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


_OWNED: dict = {}


def owned(key, make):
    """An object that a Python worker keeps between tasks. There is one at a time: workers serve all stages of a job, and
    another stage's tables would else stay in memory beside it."""
    if key not in _OWNED:
        release()
        _OWNED[key] = make()
    return _OWNED[key]


def release() -> None:
    """Drops what the worker keeps, and gives free memory back to the system where the libraries can: a worker that has
    done with one stage else holds the most that it ever needed."""
    _OWNED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id="doc_id"):
    """True for the third of the documents whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def pick(labelled: DataFrame, label: str, n: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of n ids of each label, those with the smallest hashes; all of a label that has fewer.

    Only ids whose hash is below three times the share wanted meet in the window, so what a task gathers is
    about 3 n rows a label however large the table; fewer than n of them come with a probability of e^(-0.9 n).
    """
    ids = labelled.select(id_col, label).distinct().withColumn("h", F.pmod(F.xxhash64(id_col), F.lit(1 << 40)))
    counts = ids.groupBy(label).agg(F.count(F.lit(1)).alias("all"))
    low = ids.join(counts, label).where(F.col("h") < F.lit(3.0 * n * (1 << 40)) / F.col("all"))
    at = Window.partitionBy(label).orderBy("h", id_col)
    return low.withColumn("k", F.row_number().over(at)).where(F.col("k") <= n).select(id_col, label)


MIX1, MIX2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


class WordIds(dict):
    """Numbers words as they come and keeps a 64-bit hash of each; bounded by its owner, who drops it."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def flat_words(texts, ids: WordIds, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts in one array, and each text's start in it (one more entry than texts).

    A word is ``[^\\x20\\x09-\\x0D]+``; null texts have none. ``bytes.split`` cuts at just those bytes.
    """
    parts, starts = [], [0]
    get = ids.__getitem__
    for text in texts:
        if text is None or text != text:
            starts.append(starts[-1])
            continue
        words = (text.lower() if lower else text).encode("utf-8", "surrogatepass").split()
        parts.append(np.fromiter(map(get, words), np.int64, len(words)))
        starts.append(starts[-1] + len(words))
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), np.asarray(starts, np.int64)


class TokenTable(dict):
    """Numbers the space-delimited tokens of texts at the speed of a dictionary, and keeps a row of figures for each.

    ``figures`` makes the rows of all tokens met for the first time in a call at once. All are dropped
    together before a call when there are more than ``most``, so memory is bounded by that and one call's texts.
    """

    def __init__(self, figures, most: int = 200_000):
        super().__init__()
        self.figures, self.most, self.new, self.rows = figures, most, [], None

    def __missing__(self, token: str) -> int:
        n = len(self)
        self[token] = n
        self.new.append(token)
        return n

    def read(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all tokens of all texts, one after another, and each text's start among them (one more entry than texts)."""
        if len(self) > self.most:
            self.clear()
            self.rows = None
        parts, starts, get = [], [0], self.__getitem__
        for text in texts:
            tokens = text.split() if text else ()
            parts.append(np.fromiter(map(get, tokens), np.int64, len(tokens)))
            starts.append(starts[-1] + len(tokens))
        if self.new:
            rows = self.figures(self.new)
            self.rows, self.new = rows if self.rows is None else np.concatenate([self.rows, rows]), []
        if self.rows is None:
            return self.figures([]), np.asarray(starts, np.int64)
        return self.rows[np.concatenate(parts)], np.asarray(starts, np.int64)


def slices(batches, column: str = "text", most: int = 1 << 22):
    """The batches in pieces of at most so many bytes of text (or one row), so that what is made of a batch at once is bounded too."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first, used = 0, 0
        for k, n in enumerate(sizes):
            if k > first and used + n > most:
                yield batch.slice(first, k - first)
                first, used = k, 0
            used += n
        yield batch.slice(first)


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place; the last n - 1 places have none."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    base = np.uint64(0x9DDFEA08EB382D69)
    for j in range(n):
        h *= base
        h += word_hashes[j : j + m]
    return mix64(h + GOLDEN)


def gram_places(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """True where n words from a place stay inside one text."""
    ok = np.ones(max(0, total - n + 1), bool)
    for j in range(1, n):
        at = starts[1:-1] - j
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    if z > 700:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1300.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi
