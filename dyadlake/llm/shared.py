"""What the text operators share: the shared folder, Arrow plumbing and word hashing in numpy.

Texts are handled a chunk at a time, a chunk being some rows of an Arrow batch of about ``CHUNK`` bytes, and a
single longer text in blocks of ``CHUNK`` bytes, so a task's memory follows the largest single text, times a small
factor, and never a partition or a group.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 18

#: Upper to lower case for A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: 1 for bytes of a word `[^\x20\x09-\x0D]+`, then of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
NOT_SPACE = bytes(0 if b == 0x20 or 9 <= b <= 13 else 1 for b in range(256))
ALNUM = bytes(1 if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 0 for b in range(256))

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


#: The local folder of each application without a shared one.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``). Where that is unset, a local one for a local master, and an error for any other, whose executors couldn't read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="dyadlake-")
        _local[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/dyadlake-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: a cut of the lineage that a lost executor can't undo."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: The folders that each application has written and not deleted.
_written: dict[str, list[str]] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*frames: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for frames that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df.written_at)
        _written[df.sparkSession.sparkContext.applicationId].remove(df.written_at)


def empty(spark: SparkSession) -> None:
    """Deletes all that this application's operators have written to the shared folder, once their results have been used, and restores the session's Arrow settings."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)
    for key, value in _before.pop(spark.sparkContext.applicationId, {}).items():
        spark.conf.set(key, value)


#: The Arrow settings that each application had before they were lowered.
_before: dict[str, dict[str, str]] = {}


def bound_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches that go to Python to a few megabytes, whatever the texts' lengths; smaller settings stay. Results are computed later, so the settings stay lowered until ``empty``."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key)
        if not 0 < _bytes(now) <= most:
            _before.setdefault(spark.sparkContext.applicationId, {}).setdefault(key, now)
            spark.conf.set(key, str(most))


def _bytes(value: str) -> int:
    """A size setting as a number."""
    digits = value.rstrip("bBkKmMgG")
    return int(digits) << {"k": 10, "m": 20, "g": 30}.get(value[len(digits) :].lower()[:1], 0)


def tidy(run: Callable) -> Callable:
    """Wraps a function on Arrow batches: at the end of its task, freed memory goes back to the system, since Python workers live on and wait."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def crc_fold(column: str, modulus: int):
    """crc32 of a column as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_of(frame: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [t or "" for t in frame.column(name).to_pylist()]


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` characters, or of one longer row."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def sample_by_hash(df: DataFrame, column: str, n: int) -> DataFrame:
    """The rows whose values have the n smallest distinct hashes: bounded (but for repeated values), and alike for every partitioning. Only hashes are sorted."""
    h = F.xxhash64(column)
    least = df.select(h.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(least)) if least is not None else df.where("false")


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` that clash with none of ``names``, whatever their case."""
    low = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in low]


def fresh(df: DataFrame, stem: str) -> str:
    """A name with this stem that no column of ``df`` has, whatever its case."""
    low = {c.lower() for c in df.columns}
    return next(n for n in (stem, *(f"{stem}_{k}" for k in range(len(low) + 1))) if n.lower() not in low)


def add_columns(df: DataFrame, text: str, added: dict[str, str], work: Callable[[], Callable[[list], list[list]]], keep: list[str] | None = None, where: str | None = None) -> DataFrame:
    """``keep`` (default: all columns) of ``df`` and the ``added`` ones (name to SQL type), from the texts alone.

    ``work()`` runs once a task; what it returns takes a list of texts (with None) and returns one list for each added
    column. Columns of ``df`` with an added name are replaced. ``where`` names an added boolean column: rows without
    it are dropped, and the added columns with them. Rows stay where they are: no shuffle.
    """
    bound_batches(df.sparkSession)
    names = without(df.select(*keep) if keep is not None else df, added)
    source = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(fresh(df, "whole_text")))
    types = ", ".join(f"`{k}` {v}" for k, v in added.items())
    kept = source.schema[:-1]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept)}{', ' if names else ''}{types}" if where is None else kept

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for b in batches:
            found = f(b.column(b.num_columns - 1).to_pylist())
            own = [b.column(i) for i in range(b.num_columns - 1)]
            if where is not None:
                mask = pa.array(found[list(added).index(where)], pa.bool_())
                out = pa.RecordBatch.from_arrays(own, names=names).filter(mask)
            else:
                out = pa.RecordBatch.from_arrays([*own, *(pa.array(x, ARROW[t]) for x, t in zip(found, added.values(), strict=True))], names=[*names, *added])
            yield out

    return source.mapInArrow(run, schema)


ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _powers(kind: str) -> np.ndarray:
    if kind not in _tables:
        base = _P if kind == "p" else _P_INV
        out = np.ones(CHUNK + 1, np.uint64)
        with np.errstate(over="ignore"):
            n = 1
            out[1] = base
            while n < CHUNK:  # doubling: p^(n+i) = p^n * p^i
                m = min(n, CHUNK - n)
                out[n + 1 : n + m + 1] = out[n] * out[1 : m + 1]
                n += m
        _tables[kind] = out
    return _tables[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits are equally random."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of at most CHUNK bytes, the empty one first, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("p")[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, alike wherever a span stands."""
    return mix((sums[ends] - sums[starts]) * _powers("i")[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: ``hashes``, ``starts`` and ``ends`` (bytes in ``data``), and ``first``: the words of text i are first[i]:first[i+1]."""

    def __init__(self, texts: list[str], table: bytes, lower: bool = True):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n" + b"\n".join(parts) + b"\n"
        self.data = data.translate(LOWER) if lower else data
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=at[1:])
        self.begins = at + 1  # where each text begins in data
        flags = np.frombuffer(self.data.translate(table), np.uint8)
        edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, at + 1)
        self._hash()

    def cut_at(self, places: np.ndarray) -> None:
        """Cuts words at byte places within them."""
        self.starts = np.sort(np.concatenate([self.starts, places]))
        self.ends = np.sort(np.concatenate([self.ends, places]))
        self.first = np.searchsorted(self.starts, self.begins)
        self._hash()

    def _hash(self) -> None:
        view = np.frombuffer(self.data, np.uint8)
        if len(view) <= CHUNK:
            self.hashes = span_hashes(prefix_sums(view), self.starts, self.ends)
            return
        self.hashes = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):  # blocks that end with a word
            base = self.starts[i]
            j = int(np.searchsorted(self.ends, base + CHUNK, side="right"))
            if j > i:
                block = view[base : self.ends[j - 1]]
                self.hashes[i:j] = span_hashes(prefix_sums(block), self.starts[i:j] - base, self.ends[i:j] - base)
                i = j
            else:  # one word longer than a block: folded block by block
                h = np.zeros(1, np.uint64)
                for k in range(base, self.ends[i], CHUNK):
                    block = view[k : min(k + CHUNK, self.ends[i])]
                    h = mix(h * np.uint64(_P) + span_hashes(prefix_sums(block), np.zeros(1, np.int64), np.array([len(block)])))
                self.hashes[i] = h[0]
                i += 1

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].decode("utf-8", "surrogatepass")


def sum_vectors(rows: DataFrame, kind: str = "int64") -> DataFrame:
    """Rows (key string, block int, at binary, val binary): sparse int32 positions and values; summed for each key and block.

    A task keeps one dense block, of the key it is at, and adds the sorted rows as they stream by, so its memory depends neither on how many
    rows a key has nor on how many keys there are.
    """
    dtype = np.dtype(kind)

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, np.zeros(0, dtype)

        def done() -> Iterator[pa.RecordBatch]:
            i = np.flatnonzero(have).astype(np.int32)
            if now is not None:
                yield vector_batch([(*now, i.tobytes(), have[i].tobytes())])

        for b in batches:
            for key, block, at, val in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, block) != now:
                    yield from done()
                    now, have = (key, block), np.zeros(0, dtype)
                i = np.frombuffer(at, np.int32)
                need = int(i.max()) + 1 if len(i) else 0
                if len(have) < need:
                    have = np.concatenate([have, np.zeros(need - len(have), dtype)])
                have[i] += np.frombuffer(val, dtype)
        yield from done()

    schema = "key string, block int, at binary, val binary"
    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(add, schema)


def sparse_rows(key: str | None, v: np.ndarray, block: int) -> Iterator[tuple]:
    """``v`` as rows for ``sum_vectors``, cut into blocks of ``block`` positions; empty blocks are left out."""
    for k in range(0, len(v), block):
        i = np.flatnonzero(v[k : k + block]).astype(np.int32)
        if len(i):
            yield key, k // block, i.tobytes(), v[k : k + block][i].tobytes()


def vector_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["key", "block", "at", "val"])
