"""What the training-data operators share: the cluster's shared folder, written tables and word hashing."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir

#: Words everywhere here: runs of anything but space and U+0009 to U+000D. bytes.split() splits at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Shelf:
    """Tables of one run, written to the shared folder; what is read from them survives the loss of any executor.

    put() writes and reads again, which also cuts the lineage. drop() deletes a table that no later step reads;
    the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        small_batches(spark)
        atexit.register(self._clear)

    def _clear(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended before us: nothing is left to tell
            pass

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{name}-{self.n}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._shelf_path = where
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._shelf_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(c: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(c), F.lit("")).cast("binary")


#: Rows and bytes of the batches that go between the JVM and Python workers; both sides hold a few of them a task.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
#: What Python workers keep between tasks, by name, and how each is emptied.
_kept: dict[str, Callable[[], None]] = {}


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, if they are larger."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def keeps(name: str, clear: Callable[[], None]) -> None:
    """Workers keep something under name; tasks that don't use it call clear first."""
    _kept[name] = clear


def lean(run: Callable[[Iterator], Iterator], *uses: str) -> Callable[[Iterator], Iterator]:
    """run, of a worker that first forgets what earlier steps kept, but what run uses, and at last returns free memory.

    Workers are used again by later steps of a job: without this they hold the tables of all of them.
    """

    def go(batches: Iterator) -> Iterator:
        for name, clear in _kept.items():
            if name not in uses:
                clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return go


MASK = (1 << 64) - 1
_word: dict[bytes, int] = {}
#: Words kept hashed in a Python worker before the table is emptied; a bound of memory, not of the words that count.
KEEP_WORDS = 150_000
keeps("words", _word.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, as unsigned integers."""
    if len(_word) > KEEP_WORDS:
        _word.clear()
    try:
        return np.fromiter(map(_word.__getitem__, words), np.uint64, len(words))
    except KeyError:
        known, digest = _word, xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text in which A-Z count as a-z.

    With fewer words than k, the whole sequence is the one shingle; without words, the set is empty.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    k = min(k, len(h))
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        acc = np.full(n, np.uint64(0x9E3779B97F4A7C15 * k & MASK), np.uint64)
        for i in range(k):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(acc)


#: Bytes of a text that are split into terms at a time.
TERM_BYTES = 1 << 20


def term_lists(text: bytes, fold: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists: fold gives each byte's own, a space for what stands between terms. A long text gives several lists, cut between terms."""
    text = text.translate(fold)
    at = 0
    while len(text) - at > TERM_BYTES:
        to = text.find(b" ", at + TERM_BYTES)
        if to < 0:
            break
        yield text[at:to].split()
        at = to
    yield text[at:].split()


#: Rows a function gets at a time, and bytes, if no single row has more: its lists and arrays stay small beside the batch.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces, without copies; empty batches give none."""
    for b in batches:
        step = max(1, min(SLICE_ROWS, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def arrow_map(df: DataFrame, make: Callable[[], Callable], schema: str, *uses: str) -> DataFrame:
    """df.mapInArrow with a function of one record batch, which slices() keeps small; make() runs once in each task. uses: see lean()."""

    def run(batches: Iterator) -> Iterator:
        f = make()
        yield from map(f, slices(batches))

    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run, *uses), schema)
