"""Small files and renames through Hadoop's FileSystem: the same on every scheme that Spark reads.

For markers, pointers and finished single files only; tables are written by Spark's tasks.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import is_instance_of
from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    """(the path as Hadoop's, its file system, the configuration).

    On local disks the plain file system below the one with checksum files: a file and
    its checksum cannot be replaced in one step.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return p, fs.getRawFileSystem() if _with_checksums(spark, fs) else fs, conf


def _with_checksums(spark: SparkSession, fs) -> bool:
    return is_instance_of(spark.sparkContext._gateway, fs, "org.apache.hadoop.fs.ChecksumFileSystem")


def beside(path: str) -> str:
    """A fresh path in the same folder; readers of the folder skip names with an underscore."""
    folder, slash, name = path.rpartition("/")
    return f"{folder}{slash}_{name}.{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p, fs, _ = _hadoop(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs, _ = _hadoop(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int, int]]:
    """(name, whether it is a folder, bytes, time of change) of what lies in a folder; empty if there is none."""
    p, fs, _ = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    found = [(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
    return [f for f in found if not (f[0].startswith(".") and f[0].endswith(".crc"))]


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is no such file."""
    p, fs, _ = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Move a finished file to ``target``; a reader finds the old file or the new one, whole.

    A rename that overwrites is one step where the scheme has it (HDFS, local
    disks). Object stores without it take the file's bytes in one write, which
    they publish when it is closed. A folder at ``target`` raises.
    """
    jvm = spark._jvm
    src, fs, conf = _hadoop(spark, source)
    dst = jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(dst) and fs.getFileStatus(dst).isDirectory():
        raise IsADirectoryError(f"{target} is a folder; a file of that name cannot replace it")
    fs.mkdirs(dst.getParent())
    if is_instance_of(spark.sparkContext._gateway, fs, "org.apache.hadoop.fs.RawLocalFileSystem"):
        fs.delete(jvm.org.apache.hadoop.fs.Path(dst.getParent(), f".{dst.getName()}.crc"), False)  # of an older file
        if not fs.rename(src, dst):
            raise OSError(f"{source} could not be moved to {target}")
        return
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    except Exception as e:  # py4j wraps the Java class's name in the message
        if "UnsupportedFileSystemException" not in str(e):
            raise
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, fs, dst, True, True, conf)
        return
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(fs.makeQualified(src), fs.makeQualified(dst), options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and moved into place."""
    aside = beside(path)
    p, fs, _ = _hadoop(spark, aside)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    replace_file(spark, aside, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written (a temporary one, or an old version)."""
    p, fs, _ = _hadoop(spark, path)
    fs.delete(p, True)
