"""Shared kernels of the corpus operators: Arrow text buffers, vectorised span hashing, word splitting, payload packing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_MIX1, _MIX2 = U(0xD6E8FEB86659FD93), U(0x9FB21C651E98DF25)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text that one hashing step takes; bounds the 8-byte working arrays.
STEP = 1 << 19
_BYTE = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but space, tab, LF, VT, FF and CR.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of lower-cased alphanumeric words: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. One is made only where driver and executors are one process (tests); elsewhere none set is an error."""
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="larkspan-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage through reliable checkpoint files, so lost executors never cost the upstream stages."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Ids that a join may send to every task: 16 MB.
HELD_IDS = 1 << 20


def matching(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the columns of ids; these go to every task if they are counted and few, else both sides are shuffled."""
    ids = materialize(light(ids.distinct()))
    return df.join(F.broadcast(ids) if ids.count() * len(ids.columns) <= HELD_IDS else ids, ids.columns, how)


#: A class with more than one in so many of all rows is joined by sending it to every task; there are fewer of them than this number.
HOT_PART = 1024


def by_class(rows: DataFrame, classes: DataFrame, keys: list[str], copies: str, n_rows: int) -> DataFrame:
    """Rows joined with their classes. Classes with a great part of the rows go to every task, so their rows stay where they are."""
    hot = materialize(classes.where(F.col(copies) * HOT_PART > n_rows))
    found = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    cold = found.where("_hot IS NULL").select(*rows.columns).join(classes.where(F.col(copies) * HOT_PART <= n_rows), keys)
    return found.where("_hot").drop("_hot").unionByName(cold)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def light(df: DataFrame) -> DataFrame:
    """For narrow rows that come out of an exchange: fewer, larger partitions, so that their files are not mostly overhead."""
    return df.coalesce(max(1, shuffle_partitions(df.sparkSession) // 8))


def mapped(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers, which Spark uses again, give their memory back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return
    trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= _MIX1
    h ^= h >> U(29)
    h *= _MIX2
    h ^= h >> U(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, STEP) + 1
        found = []
        for base in (_BASE, _BASE_INV):
            x = np.full(size, U(base))
            x[0] = 1
            found.append(np.cumprod(x, dtype=U))
        _powers[:] = found
    return _powers[0], _powers[1]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """P with (P[e] - P[s]) * base**-s a hash of b[s:e]."""
    p = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTE[b] * powers(len(b))[0][: len(b)], out=p[1:])
    return p


def span_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span b[s:e]; spans are ascending and do not overlap. Works in steps, so memory is bounded by the longest span."""
    out, i = np.empty(len(s), U), 0
    while i < len(s):
        j = max(int(np.searchsorted(e, s[i] + STEP, "right")), i + 1)
        lo = int(s[i])
        p, x, y = prefix_hashes(b[lo : int(e[j - 1])]), s[i:j] - lo, e[i:j] - lo
        out[i:j] = mix((p[y] - p[x]) * powers(len(p))[1][x] + (y - x).astype(U) * _MIX2)
        i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text starts and ends; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at[:-1] - at[0], at[1:] - at[0]


def groups(starts: np.ndarray, ends: np.ndarray, max_bytes: int = STEP, max_docs: int = 256) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most max_bytes together (one document where it alone is longer)."""
    i, n = 0, len(starts)
    while i < n:
        j = min(max(int(np.searchsorted(ends, starts[i] + max_bytes, "right")), i + 1), i + max_docs, n)
        yield i, j
        i = j


def word_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (maximal run of bytes in the table, within a document), and the number of words of each document."""
    inside = table[b]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = ends > starts
    first[starts[full]] = inside[starts[full]]
    last[ends[full] - 1] = inside[ends[full] - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, ends) - np.searchsorted(s, starts)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    h = np.zeros(size, U)
    for j in range(n):
        h *= _MIX1
        h += words[j : j + size]
    return mix(h + U(n))


def sliding(x: np.ndarray, width: int, op=np.minimum) -> np.ndarray:
    """op over every width consecutive elements, by doubling."""
    m, w = x, 1
    while w * 2 <= width:
        m = op(m[:-w], m[w:])
        w *= 2
    return op(m[: len(m) - (width - w)], m[width - w :]) if w < width else m


def pack(*columns: np.ndarray) -> bytes:
    """Equally long numeric columns as one compressed payload: bytes of one significance lie together, so small numbers cost little."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(payload: bytes, *types: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(widths), 0, []
    for t, w in zip(types, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket number with the (ascending) positions of its rows."""
    order = np.argsort(bucket, kind="stable")
    at = bucket[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(bucket[rows[0]]), rows


def doc_group(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) % U(n)).astype(np.int64)


def merged(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Input batches cut so that each holds about max_bytes of the text column at most (one row where it alone is longer)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, s, e = text_bytes(batch.column(batch.schema.get_field_index(column)))
        for i, j in groups(s, e, max_bytes, batch.num_rows):
            yield batch.slice(i, j - i)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Files whose paths may go to every task: some 10 MB.
HELD_FILES = 1 << 16


def with_row_key(docs: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    """The columns of docs and a number for each row, the same whenever they are read again, so that rows without an id or with a repeated one can be
    told apart. None of the columns may begin with an underscore or have the number's name.

    A plain read of at most ``HELD_FILES`` files has it from the file's place among the sorted paths, which go to every task, and the row's place in
    the file. Any other docs are written to the shared folder first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            placed = docs.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
        except AnalysisException:  # files of a kind without row numbers
            placed = None
        if placed is not None:
            paths = sorted(r[0] for r in placed.select("_path").distinct().limit(HELD_FILES + 1).collect())
        if placed is not None and len(paths) <= HELD_FILES:
            places = docs.sparkSession.createDataFrame(list(enumerate(paths)), "_file long, _path string")
            return placed.join(F.broadcast(places), "_path").withColumn(name, F.shiftleft("_file", 40) + F.col("_at")).select(*columns, name)
    folder = f"{checkpoint_dir(docs.sparkSession)}/rows-{uuid4().hex}"
    docs.select(*columns).withColumn(name, F.monotonically_increasing_id()).write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate results, by Spark's own file systems."""
    files, path = _hadoop(spark, folder)
    files.delete(path, True)


def new_folder(spark: SparkSession, folder: str) -> str:
    """Makes a folder, by Spark's own file systems, and returns its full path."""
    files, path = _hadoop(spark, folder)
    files.mkdirs(path)
    return files.getFileStatus(path).getPath().toString()


def documents_input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names: further columns, of whatever name, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def carried(own: DataFrame, carry: list[str] | None) -> str:
    """The part of a schema for the text and the columns that an operator carries along."""
    return "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in ["text", *carry]) if carry else ""
