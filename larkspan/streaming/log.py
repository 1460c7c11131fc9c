"""A log of numbered small files that several writers extend: each number is written once, by whoever comes first."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the entries there are, ascending."""
    files, where = _files(spark, folder)
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def entry(spark: SparkSession, folder: str, number: int) -> dict:
    files, where = _files(spark, f"{folder}/{number:020d}.json")
    stream = files.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Writes the entry of this number, whole or not at all. False if there is one already.

    The content goes to a file of its own first. On a local file system a hard link then gives it its name, which fails where the name is taken; on others
    it is a rename that never replaces."""
    jvm = spark._jvm
    files, where = _files(spark, folder)
    files.mkdirs(where)
    where = files.getFileStatus(where).getPath()
    own = jvm.org.apache.hadoop.fs.Path(where, f".{uuid4().hex}")
    stream = files.create(own, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(where, f"{number:020d}.json")
    try:
        if files.getUri().getScheme() == "file":
            jvm.java.nio.file.Files.createLink(*(jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, own)))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(own, target, none)
        return True
    except Exception as e:
        if not files.exists(target) or "AlreadyExists" not in str(e):
            raise
        return False
    finally:
        files.delete(own, False)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def children(spark: SparkSession, folder: str) -> list[str]:
    files, where = _files(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []
