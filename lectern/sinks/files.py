"""Small files and folders through the file systems that Spark's own readers use."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    (a, fs), (b, _) = file_system(spark, old), file_system(spark, new)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{old} could not be moved to {new}")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    p, fs = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def link_if_absent(spark: SparkSession, text: str, path: str) -> bool:
    """Whether a file of this text was put at path: as a whole, and only if there was none.

    The text is written under another name first. A local file then gets its name by a hard link, which fails where one
    is; elsewhere by a rename, which distributed file systems refuse where one is.
    """
    jvm = spark._jvm
    p, fs = file_system(spark, path)
    fs.mkdirs(p.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            at = lambda x: jvm.java.nio.file.Path.of(x.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            try:
                jvm.java.nio.file.Files.createLink(at(p), at(draft))
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
            return True
        return not fs.exists(p) and bool(fs.rename(draft, p))
    finally:
        fs.delete(draft, False)
