"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes that stand between words.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: The same as a Java regular expression class, and a word.
SEPARATOR_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: What operators keep in a worker between tasks, by a name for each.
kept: dict[str, dict] = {}


def lean(keep: str = "") -> None:
    """Frees what other operators than `keep` have left in this worker, which Spark reuses for the next one's tasks."""
    held = [cache for name, cache in kept.items() if name != keep and cache]
    for cache in held:
        cache.clear()
    if held:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share; it goes when the application ends.

    Only where that setting is missing on a single machine, as in tests, a temporary folder serves; on a
    cluster each executor would write to its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quartzline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quartzline-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame) -> DataFrame:
    """Only doc_id as bigint and text as string, so that no other column can clash."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unused(name: str, df: DataFrame) -> str:
    """`name`, with underscores added until no column of `df` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def frames(texts: pa.Array) -> pa.Array:
    """Each text, of which none is null, as a zstd frame."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(x.as_buffer().to_pybytes()) for x in texts], pa.binary())


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """`df` with the strings of `column`, of which none is null, as zstd frames.

    Texts cross an exchange in two thirds of the bytes that Spark's own compression leaves of them.
    `unpacker` gives them back inside a task, one at a time.
    """
    # columns that are never null stay so: no filter of nulls then sets two uses of one frame apart
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType, f.nullable) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([frames(batch.column(n)) if n == column else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return df.mapInArrow(run, schema)


def unpacker() -> Callable[[pa.Scalar], bytes]:
    """Turns a value of a `packed` column into the bytes of its text."""
    decompress = zstandard.ZstdDecompressor().decompress
    return lambda frame: decompress(frame.as_buffer().to_pybytes())


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about `limit` bytes of text, for bounded memory.

    Yields the rows, all their bytes, and the offsets of each row in them. Null texts are empty.
    """
    array = batch.column(batch.schema.get_field_index(column)).fill_null("")
    offsets = _offsets(array)
    row, rows = 0, len(array)
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[row] : offsets[end]]
        yield batch.slice(row, end - row), data, offsets[row : end + 1] - offsets[row]
        row = end


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """Hashes of byte ranges of one array, from prefix sums of a polynomial modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(RangeHash._powers) < n:
            size = max(n, 1 << 20)
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(RangeHash, name, np.cumprod(factors))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[1:n], out=self.sums[1:])
        if len(RangeHash._powers) > 1 << 20:  # a very long text leaves no large tables behind
            self._powers, self._inverses = RangeHash._powers, RangeHash._inverses
            RangeHash._powers = RangeHash._inverses = np.ones(1, np.uint64)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self._inverses[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row (one more entry at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_IS_SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the first word of each row."""
    data = lower(data)
    starts, ends, first = words_of(data, offsets)
    return RangeHash(data)(starts, ends), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row: the sorted distinct hashes of its runs of k words, or of all its words where it has fewer."""
    out = []
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(len(hashes) - k + 1, 0)
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs += hashes[i : i + n] * factors[i]
    runs = mix(runs)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))
