"""Small files and folders on whatever file system a path names, for states that several writers share."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _local(spark: SparkSession, path: str) -> str | None:
    """The path on this machine if the path's file system is the local one."""
    fs, p = _fs(spark, path)
    return urlparse(fs.makeQualified(p).toString()).path if fs.getUri().getScheme() == "file" else None


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it doesn't exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a folder in one step; false if it isn't there."""
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.rename(p, _fs(spark, to)[1])


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with this content, whole or not at all; false if a file has that name. Of several writers one succeeds: by a hard link on a local file
    system, elsewhere by a rename that doesn't overwrite (atomic on HDFS; an object store needs a connector whose rename is)."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    here = _local(spark, draft)
    if here is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        with open(here, "w") as f:
            f.write(text)
        try:
            os.link(here, os.path.join(os.path.dirname(here), name))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
    fs, p = _fs(spark, draft)
    stream = fs.create(p, False)
    stream.write(text.encode())
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(p, _fs(spark, path)[1], spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception:
        fs.delete(p, False)
        if fs.exists(_fs(spark, path)[1]):
            return False
        raise
