"""Token counts of documents in flat, unindexed token files, by separator scan.

A flat file is nothing but ids; documents end with the end-of-document id. It is cut into blocks at any place. Each block is searched as one
vector for separators; a prefix scan over the blocks of a file (running number of tokens and of separators, last separator so far) stitches the
documents that lie across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import checkpoint_dir, mapped, materialize, new_folder
from .tokens import default_vocabulary, encoder

#: Tokens of a block; blocks that one row of the upper level of the scan sums up.
BLOCK, CHUNK = 1 << 16, 1024
_BLOCKS = "file long, block long, payload binary"


def flat_files(spark: SparkSession, path: str) -> DataFrame:
    """The flat files in a folder, as Spark lists them: file (hash of its path), path, length."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "path", "length")


def flat_file_blocks(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK, blocks_each: int = CHUNK) -> DataFrame:
    """Blocks of the flat files in a folder: file, block, payload. block_bytes must be a multiple of the id's width.

    Spark lists the files and their lengths; each task reads its own range of ``blocks_each`` blocks, so a file may be of any size. Files in a store
    that only Spark's readers can open are read as whole rows by them instead, which they refuse beyond 2 GB a file."""
    listed = flat_files(spark, path)
    first = listed.limit(1).collect()
    if first and not _opened(first[0].path):

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data = memoryview(content.as_buffer())
                    for i in range(0, max(len(data), 1), block_bytes):
                        yield _block(file, i // block_bytes, bytes(data[i : i + block_bytes]))

        return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content").transform(mapped, cut, _BLOCKS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, name, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = FileSystem.from_uri(_uri(name))
                with system.open_input_file(at) as f:
                    for block in range(start, min(start + blocks_each, max(-(-length // block_bytes), 1))):
                        yield _block(file, block, f.read_at(min(block_bytes, length - block * block_bytes), block * block_bytes) if length else b"")

    step = block_bytes * blocks_each
    last = F.greatest(F.ceil(F.col("length") / step) - 1, F.lit(0)).cast("long")
    ranges = listed.select("file", "path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"), "length").repartition("file", "i")
    return ranges.select("file", "path", (F.col("i") * blocks_each).alias("start"), "length").transform(mapped, read, _BLOCKS)


def write_flat_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes documents to flat files of ids (16-bit, or 32-bit from an ``end`` of 2**16 on), one for each task, in a folder that all executors share.

    Returns which documents went where: part (the number in the file's name), first (the ordinal in it of the first of them), doc_ids. The files are
    written when the rows are made; a task that runs again writes the same bytes, and a file takes its name when it is whole. Special tokens' strings in
    a text are ordinary text, so no document holds the separator."""
    vocabulary, dtype = vocabulary or default_vocabulary(), "<u2" if end < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(vocabulary, True), TaskContext.get()
        part, first, out = context.partitionId(), 0, None
        system, base = FileSystem.from_uri(_uri(folder))
        name, held = f"{base}/part-{part}.bin", f"{base}/_{part}-{context.taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(held)
            for text in batch.column(1):
                out.write(np.append(encode(text.as_py() or ""), end).astype(dtype).tobytes())
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0).cast(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], pa.int64()), ids], ["part", "first", "doc_ids"])
            first += batch.num_rows
        if out is not None:
            out.close()
            if system.get_file_info(name).type != FileType.NotFound:
                system.delete_file(name)
            system.move(held, name)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.transform(mapped, run, "part long, first long, doc_ids array<long>")


def _block(file: int, number: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([payload], pa.binary())], ["file", "block", "payload"])


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _opened(path: str) -> bool:
    """Whether Arrow's file systems know the path's store."""
    try:
        FileSystem.from_uri(_uri(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def flatten(docs: DataFrame, vocabulary: str | None = None, end: int = 50256, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as flat token files, one for each task, in blocks of 16-bit ids (32-bit from 2**16 on): file, block, payload, and doc_ids, the
    documents whose separators lie in the block. Special tokens' strings in a text are ordinary text, so no document holds the separator."""
    vocabulary, dtype = vocabulary or default_vocabulary(), "<u2" if end < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, True)
        file = TaskContext.get().partitionId() if TaskContext.get() else 0
        held, size, ended, number = [], 0, [], 0

        def cut(all_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, ended, number
            if size < block and not (all_ and size):
                return
            flat = np.concatenate(held)
            at = np.array([p for p, _ in ended], np.int64)
            for i in range(0, len(flat) if all_ else len(flat) - block + 1, block):
                own = [ended[x][1] for x in np.flatnonzero((at >= i) & (at < i + block))]
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([flat[i : i + block].astype(dtype).tobytes()], pa.binary()), pa.array([own], pa.list_(pa.int64()))], ["file", "block", "payload", "doc_ids"])
                number += 1
            done = len(flat) if all_ else len(flat) // block * block
            held, size, ended = [flat[done:]], len(flat) - done, [(p - done, d) for p, d in ended if p >= done]

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end)
                held.append(ids)
                size += len(ids)
                ended.append((size - 1, doc))
                if size >= block * 4:
                    yield from cut(False)
        yield from cut(False)
        yield from cut(True)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.transform(mapped, run, f"{_BLOCKS}, doc_ids array<long>")


def _scan(end: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = [], []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_buffer() if payload.is_valid else b"", dtype)
                n.append(len(ids))
                at.append(np.flatnonzero(ids == end))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int64()))], ["file", "block", "n", "ends"])

    return run


def separator_scan(blocks: DataFrame, end: int = 50256, dtype: str = "<u2") -> DataFrame:
    """Documents of flat files given as (file, block, payload): file, ordinal (of the document within its file, from 0), start, n_tokens (without
    the separator). Tokens after a file's last separator are a last document.

    Blocks of a file are those numbers there are, in ascending order; a repeated block is an error of the input and counts twice. Null or empty
    payloads hold no tokens. Empty documents (two separators in a row) are documents of 0 tokens. Empty table: empty result.
    """
    found = blocks.select(F.col("file").cast("long").alias("file"), F.col("block").cast("long").alias("block"), F.col("payload")).transform(mapped, _scan(end, dtype), "file long, block long, n long, ends array<long>")
    found = materialize(found.withColumn("chunk", F.floor(F.col("block") / CHUNK)))
    last = F.try_element_at("ends", F.lit(-1))

    def scanned(df: DataFrame, keys: list[str], order: str, n: Column, k: Column, last: Column, names: tuple[str, str, str]) -> DataFrame:
        """Sums of n and k and the place of the last separator over the rows before, within keys. Two steps, as places need the first sums."""
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn(names[0], F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn(names[1], F.coalesce(F.sum(k).over(before), F.lit(0)))
        return df.withColumn("_place", F.col(names[0]) + last).withColumn(names[2], F.max("_place").over(before))

    inner = scanned(found, ["file", "chunk"], "block", F.col("n"), F.size("ends"), last, ("t1", "k1", "l1"))
    sums = inner.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum(F.size("ends")).alias("k"), F.max("_place").alias("last"))
    outer = scanned(sums, ["file"], "chunk", F.col("n"), F.col("k"), F.col("last"), ("t0", "k0", "l0")).select("file", "chunk", "t0", "k0", "l0")
    placed = inner.join(outer, ["file", "chunk"]).select(
        "file", (F.col("t0") + F.col("t1")).alias("at"), (F.col("k0") + F.col("k1")).alias("first"), F.coalesce(F.col("t0") + F.col("l1"), F.col("l0"), F.lit(-1)).alias("last"), "ends"
    )
    # Within a block each document starts after the separator before it.
    rows = placed.select("file", "at", "first", "last", "ends", F.posexplode("ends").alias("i", "e"))
    start = F.when(F.col("i") == 0, F.col("last") + 1).otherwise(F.col("at") + F.get("ends", F.col("i") - 1) + 1)
    whole = rows.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("e")).alias("stop"))
    whole = whole.select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))
    ends = sums.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    last_end = outer.join(sums, ["file", "chunk"]).groupBy("file").agg(F.coalesce(F.max(F.col("t0") + F.col("last")), F.lit(-1)).alias("l"))
    rest = ends.join(last_end, "file").where("n > l + 1").select("file", F.col("k").alias("ordinal"), (F.col("l") + 1).alias("start"), (F.col("n") - F.col("l") - 1).alias("n_tokens"))
    return whole.union(rest)


def token_counts(docs: DataFrame, vocabulary: str | None = None, end: int = 50256, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, file (its number), ordinal, start, n_tokens of each document, counted by a separator scan of flat files that are made of them first, in the shared
    folder (as rows of blocks, where only Spark can open that folder).

    Null or empty text: 0 tokens. Null id: counted, doc_id null. Repeated rows: counted each. Empty table: empty result. Other columns are not read.
    """
    spark, dtype = docs.sparkSession, "<u2" if end < 1 << 16 else "<u4"
    folder = new_folder(spark, f"{checkpoint_dir(spark)}/flat-{uuid4().hex}")
    if _opened(folder):
        index = materialize(write_flat_files(docs, folder, vocabulary, end, id_col, text_col))
        counts = separator_scan(flat_file_blocks(spark, folder, block * np.dtype(dtype).itemsize), end, dtype)
        parts = flat_files(spark, folder).select("file", F.regexp_extract("path", r"part-(\d+)\.bin$", 1).try_cast("long").alias("part"))
        index = index.join(parts, "part")
        number = "part"
    else:
        flat = materialize(flatten(docs, vocabulary, end, block, id_col, text_col))
        counts = separator_scan(flat, end, dtype)
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        number = "file"
        index = flat.select("file", "block", "doc_ids").withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
    # Where the n-th document of a file went: the scan itself knows files and ordinals only.
    index = index.select("file", F.col(number).alias("number"), "first", F.posexplode("doc_ids").alias("i", "doc_id"))
    index = index.select("file", "number", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return index.join(counts, ["file", "ordinal"]).select("doc_id", F.col("number").alias("file"), "ordinal", "start", "n_tokens")
