"""Helpers that the training-data operators share: table access, durable
intermediates and vectorised hashing of the bytes of Arrow string columns."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text handled at a time inside a Python worker; a longer document is handled alone.
CHUNK_BYTES = 1 << 20


def plain_unions(spark: SparkSession) -> SparkSession:
    """Unions in this session don't keep their inputs' partitioning: where adaptive execution regroups the partitions of one input alone, such a union of Spark 4.1 fails
    (Can't zip RDDs with unequal numbers of partitions)."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain_unions(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none: a folder of its own, in the warehouse, or a temporary one where all runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)  # executors of local-cluster have folders of their own
        top = tempfile.mkdtemp(prefix="lorewell-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lorewell"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table written by materialize()."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _written:
        try:
            forget(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage durably: writes df as Parquet under spark.checkpoint.dir and rereads it."""
    spark = plain_unions(df.sparkSession)
    path = f"{shared_folder(spark)}/lorewell/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bounds the rows of an Arrow batch, as texts may be long: workers hold a batch or two at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def lean(run: Callable) -> Callable:
    """run, a function over Arrow batches, with the worker's free memory going back to the system at its end: workers are
    used again, and what one operator has freed would stay with the process."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return tidy


def documents_text(df: DataFrame) -> DataFrame:
    """doc_id and text alone, with a null text as the empty one."""
    small_batches(df.sparkSession)
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, base & _MASK, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] the polynomial hash of buf[s:e], times base**s."""
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTE[buf] * powers(_BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end], the same for the same bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(_BASE_INV, len(prefix))[start])


def text_buffers(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string or binary column: (first row, last row + 1, its bytes, offsets from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, last, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 9 to 13, or of those that inside, a table of 256 truth values, has (no run crosses a text), and
    for each text the index of its first run, with the total at the end."""
    solid = np.ones(len(buf) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = (buf != 32) & ((buf < 9) | (buf > 13)) if inside is None else inside[buf]
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[offs] = True
    body = solid[1:-1]
    starts = np.flatnonzero(body & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(body & (~solid[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
