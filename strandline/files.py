"""Folders on whatever file system a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder, files = _open(spark, path)
    return files.exists(folder)


def any_match(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder matches a path pattern."""
    folder, files = _open(spark, pattern)
    return bool(files.globStatus(folder))


def matches(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files and folders that match a path pattern."""
    folder, files = _open(spark, pattern)
    return sorted(status.getPath().toString() for status in files.globStatus(folder) or [])


def delete_folder(spark: SparkSession, path: str) -> None:
    folder, files = _open(spark, path)
    files.delete(folder, True)


def make_folder(spark: SparkSession, path: str) -> None:
    folder, files = _open(spark, path)
    files.mkdirs(folder)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column, from the names of the folders right below ``path``."""
    folder, files = _open(spark, path)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}="))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right below ``path``; none if it does not exist."""
    folder, files = _open(spark, path)
    return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    """Content of a small file."""
    file, files = _open(spark, path)
    stream = files.open(file)
    try:
        return bytearray(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet; it is seen as a whole or not at all.

    Of two writers of one path, the second one fails.
    """
    file, files = _open(spark, path)
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{file.getParent()}/.{file.getName()}.{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), spark._jsc.hadoopConfiguration())
    keep_what_is_there = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, file, keep_what_is_there)
    except Exception as error:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            raise FileExistsError(f"{path} has been written by another job") from None
        raise
