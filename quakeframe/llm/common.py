"""Helpers that the corpus operators share: the shared folder, Arrow batches of text, and hashes of words.

Words are hashed straight from the UTF-8 bytes of an Arrow column, a slice of about half a megabyte at a time, so
no operator builds a Python object per word and memory stays bounded by the slice (or by one document).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ---------------------------------------------------------------- session and shared folder


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: one row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: this cuts lineage and outlives lost executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored`` with the table's path."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def read_table(path: str) -> pa.Table:
    """A stored table of checked size, read by a task from the shared folder."""
    fs, root = pafs.FileSystem.from_uri(uri(path))
    return pq.read_table(root, filesystem=fs)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Stores a side of a join and marks it for broadcast if it is counted to have few rows; else it is shuffled."""
    df = stored(df, "side")
    return F.broadcast(df) if df.count() <= most else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less its columns of these names in any case, as Spark resolves names."""
    gone = {n.lower() for n in names}
    return df.select(*(quoted(c) for c in df.columns if c.lower() not in gone)) if gone & {c.lower() for c in df.columns} else df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def fold(modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) leaves the remainder; false for a null id."""
    return F.coalesce(crc_of_id() % modulus == remainder, F.lit(False))


# ---------------------------------------------------------------- positions


def ranked(df: DataFrame, group: list[str], order: list[str], position: str = "position", count: str = "group_rows") -> DataFrame:
    """``df`` with the gapless position, from 0, of each row in its group by ``order`` (nulls first), and the group's count of rows.

    Rows are ranged by group and order over all tasks and stored with a number; positions follow from how many rows of the group
    the ranges before hold. Rows alike in all these columns are dealt over ranges too, so neither a hot group nor a hot row is one task.
    """
    tie, at, part, before, first = unused(df, "tie__", "at__", "part__", "before__", "first__")
    keys = [*group, *order, tie]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stored(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()), "ranked")
    of_row = F.shiftright(at, 33)
    # at most a row for each range and one for each group
    counts = rows.groupBy(of_row.alias(part), *group).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(count))
    whole = Window.partitionBy(*group)
    sums = F.coalesce(F.sum(count).over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = {g: f"{part}{i}" for i, g in enumerate(group)}
    counts = counts.select(F.col(part), *(F.col(g).alias(n) for g, n in named.items()), first, sums.alias(before), F.sum(count).over(whole).alias(count))
    on = of_row == F.col(part)
    for g, n in named.items():
        on &= F.col(g).eqNullSafe(F.col(n))
    joined = rows.join(small(counts), on)
    return joined.select(*(quoted(c) for c in df.columns), (F.col(at) - F.col(first) + F.col(before)).alias(position), count)


# ---------------------------------------------------------------- Arrow batches


def with_columns(
    df: DataFrame, fields: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]], text: str = "text"
) -> DataFrame:
    """Appends columns that ``make`` derives from the text column of each Arrow batch (nulls arrive as empty
    texts). Columns of the same names, in any case, are replaced; all others pass through unchanged."""
    names = [f.name for f in fields]
    kept = without(df, [n for n in names if n.lower() != text.lower()])
    schema = T.StructType([*kept.schema.fields, *fields])
    at = [c.lower() for c in kept.columns].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make(filled(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    tune(df.sparkSession)
    return kept.mapInArrow(run, schema)


def filled(col: pa.Array) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of slices of about ``limit`` bytes;
    a longer document is a slice of its own."""
    if not len(col):
        return
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


# ---------------------------------------------------------------- words and their hashes

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** k modulo 2 ** 64 for k below n; kept for usual slices."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_values(lower: bool, seed: int = 7) -> np.ndarray:
    """A 64-bit value for each byte; with ``lower`` A-Z have those of a-z."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        values[65:91] = values[97:123]
    return values


VALUES, VALUES_LOWER = byte_values(False), byte_values(True)


class Words:
    """The words of a slice: first and after-last byte, document, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool, sep: np.ndarray = SPACES):
        n = len(data)
        inside = np.empty(n + 1, dtype=bool)
        inside[:n] = ~sep[data]
        inside[n] = False
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:]
        self.starts = np.flatnonzero(begins)
        finishes = np.zeros(n + 1, dtype=bool)
        finishes[1:] = inside[:-1] & (~inside[1:] | edge[1:])
        self.ends = np.flatnonzero(finishes)
        self.doc = np.searchsorted(offs, self.starts, side="right") - 1
        self.n_docs = len(offs) - 1
        #: words of document d: first[d] to first[d + 1]
        self.first = np.searchsorted(self.starts, offs)
        self._data, self._values = data, VALUES_LOWER if lower else VALUES
        self._sums = None

    def hash(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the byte ranges (of the words, by default)."""
        if self._sums is None:
            n = len(self._data)
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self._values[self._data] * _power(_R, n), out=self._sums[1:])
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        h = (self._sums[ends] - self._sums[starts]) * _power(_RINV, len(self._data) + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def shingle_hashes(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each n-word window in order; a document of fewer words gives its whole sequence."""
    h = words.hash()
    if not len(h):
        return h, words.doc
    count = np.diff(words.first)
    k = len(h) - n + 1
    out, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if k > 0:
        acc = h[:k].copy()
        for j in range(1, n):
            acc = acc * np.uint64(_R) + h[j : j + k]
        whole = words.doc[:k] == words.doc[n - 1 :]
        out, doc = mix(acc[whole]), words.doc[:k][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            acc = 0
            for x in h[words.first[d] : words.first[d + 1]].tolist():
                acc = (acc * _R + x) % (1 << 64)
            extra[i] = (acc + int(count[d]) * 0x632BE59BD9B4E019) % (1 << 64)
        out, doc = np.concatenate([out, mix(extra)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
