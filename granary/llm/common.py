"""Shared pieces: bounded Arrow batches, hashes over bytes, and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import freed

#: Most bytes of text that a Python worker expands at once (a single longer text is one chunk).
CHUNK_BYTES = 1 << 20
#: Most rows and bytes that a checked broadcast may have; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of at most about `limit` bytes in column `text`; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and the n+1 offsets; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Tables that a worker keeps from task to task for one operator; tasks of others empty them.
KEPT: list[dict] = []


def give_back(run):
    """run (an iterator of batches to an iterator of batches), after which the worker returns freed memory to the system.

    Workers outlive their tasks and would hold the most that any of them has needed, and what other
    operators keep in them.
    """

    @functools.wraps(run)
    def outer(batches):
        for table in KEPT:
            table.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return outer


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    return h * MIX


#: Odd base of the polynomial hash, and its inverse modulo 2^64.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, I): the hash of data[i:j] is (P[j] - P[i]) * I[i] modulo 2^64, for any i <= j."""
    n = len(data)
    if len(_POWERS.get("up", ())) < n + 1:
        m = max(n + 1, 1 << 16)
        _POWERS["up"], _POWERS["down"] = powers(BASE, m), powers(INVERSE, m)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _POWERS["up"][:n]
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=out[1:])
    return out, _POWERS["down"][: n + 1]


#: Bytes that belong to words: 0-9, a-z, A-Z (lower-cased first) and every byte of a non-ASCII character.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x41:0x5B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, docs): the 64-bit hash of each word in order, and the number of words before each text.

    Words are runs of 0-9, A-Z (lower-cased), a-z and non-ASCII characters; texts are never joined.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    inside = _WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    p, inv = prefix_hash(low)
    return mix((p[ends] - p[starts]) * inv[starts]), np.searchsorted(starts, offsets, side="left")


def shingles(hashes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the runs of k words of each text; a text of 1 to k-1 words has one shorter run."""
    n = np.diff(docs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(n)), count)
    first = docs[:-1][owner] + np.arange(offsets[-1]) - offsets[:-1][owner]
    p = np.zeros(len(hashes) + 1, np.uint64)
    out = np.zeros(len(first), np.uint64)
    length = np.minimum(n[owner], k)
    for j in range(k):
        more = length > j
        at = np.where(more, first + j, 0)
        step = mix(out + hashes[at] + np.uint64(j + 1)) if len(hashes) else out
        out = np.where(more, step, out)
    del p
    return out, offsets


#: Rows and bytes of an Arrow batch at most (a longer text stands alone): a batch stands in the JVM and in a worker at once.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def lean(df: DataFrame) -> DataFrame:
    """df, after limiting the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, so that workers stay small whatever the texts' length."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(conf.get(key).rstrip("b")) <= most:
            conf.set(key, str(most))
    return df


def _small(df: DataFrame, rows: int, size: int) -> bool:
    """Whether df has at most so many rows, of at most so many bytes: a field counts 8, and strings and binaries their length besides."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    if any(f.dataType.typeName() in ("array", "map", "struct") for f in df.schema.fields):
        return False
    fixed = 16 + 8 * len(df.columns)
    most = min(rows, size // fixed)
    length = F.lit(0)
    for name in wide:
        length = length + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    n, more = df.select(length.cast("long").alias("b")).limit(most + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= most and n * fixed + more <= size


def bounded_join(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """left join right, broadcasting right only where its rows and bytes, counted first, are few enough; else both are shuffled.

    `right` is read by an action, so pass one that is cheap to compute twice or already cut. Rows with
    nested columns are never broadcast.
    """
    return left.join(F.broadcast(right) if _small(right, rows, size) else right, on, how)


def keyed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left inner join right (one row a key, of any width), where few rows of left have a partner.

    Only right's keys, of fixed width, may be broadcast, and only up to BROADCAST_ROWS of them; the
    rows of left that have a partner are then shuffled to right's.
    """
    keys = right.select(F.col(right_key).alias("_few"))
    return bounded_join(left, keys, F.col(left_key) == F.col("_few"), "left_semi").join(right, F.col(left_key) == F.col(right_key))


def spread(df: DataFrame) -> DataFrame:
    """df (narrow: keys and counts) dealt anew row by row.

    A side that is an aggregate by the join's key lends the join its partitioning, and adaptive
    execution can then not split a hot key's rows on the other side. Dealt anew, both sides are
    shuffled for the join alone, and it can.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores before it as it takes to be no column of df (in either case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one, once what was made of its tables is kept."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, path: str) -> DataFrame:
    """df by way of Parquet in the shared folder: packed, where a checkpoint would hold whole rows, and without its partitioning."""
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
