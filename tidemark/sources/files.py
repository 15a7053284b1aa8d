"""Small files beside the data (manifests, commit records), by Hadoop's file system so that any shared store serves."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _linked(spark: SparkSession, written: str, path: str) -> bool:
    """On a local disk: a second name for the whole file, which the kernel refuses where the name is taken."""
    local = lambda x: unquote(urlparse(x).path) if x.startswith("file:") else x
    try:
        os.link(local(written), local(path))
    except FileExistsError:
        return False
    return True


def _renamed(spark: SparkSession, written: str, path: str) -> bool:
    """On a file system whose rename is atomic and doesn't overwrite."""
    jvm, p, fs = _fs(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(written), p, none)
    except Exception as e:  # py4j wraps FileAlreadyExistsException
        if "AlreadyExists" in str(e) or fs.exists(p):
            return False
        raise
    return True


#: How a file that was written under another name gets its own, by scheme: all or nothing, and only if the name is free. A
#: store without atomic rename needs a function of its own here, a conditional put.
PUBLISH: dict[str, Callable[[SparkSession, str, str], bool]] = {"file": _linked, **dict.fromkeys(("hdfs", "viewfs", "ofs", "abfs", "abfss"), _renamed)}


def create_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Writes ``value`` to a new file; False where the file exists (put if absent).

    The value is first written whole under a hidden name and then published, so readers never see a part of it, a writer
    that dies leaves no record behind, and of two writers one gets False.
    """
    jvm, p, fs = _fs(spark, path)
    publish = PUBLISH.get(fs.getUri().getScheme())
    if publish is None:
        raise NotImplementedError(f"no way to put a file if absent is known for {fs.getUri().getScheme()}; add one to PUBLISH")
    if fs.exists(p):
        return False
    folder, name = path.rsplit("/", 1)
    written = f"{folder}/.{name}.{uuid.uuid4().hex}"
    out = fs.create(jvm.org.apache.hadoop.fs.Path(written), False)
    try:
        out.write(bytearray(json.dumps(value, default=str).encode()))
    finally:
        out.close()
    try:
        return publish(spark, written, path)
    finally:
        remove(spark, written)


def read_json(spark: SparkSession, path: str) -> dict:
    """The object in a file."""
    jvm, p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the entries of a folder; none where it doesn't exist."""
    _, p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder if it exists."""
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)
