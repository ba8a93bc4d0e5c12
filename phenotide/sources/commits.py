"""Numbered versions of a stored table, each committed as one file that is there as a whole or not at all."""

from __future__ import annotations

import json
import re
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_NUMBERED = re.compile(r"(\d+)\.json")


class VersionConflict(RuntimeError):
    """Somebody else committed the same version of a table first."""


def latest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The highest committed version and its record; 0 and nothing where no version was committed."""
    files, path = _file_system(spark, folder)
    if not files.exists(path):
        return 0, {}
    numbers = [int(m[1]) for status in files.listStatus(path) if (m := _NUMBERED.fullmatch(status.getPath().getName()))]
    if not numbers:
        return 0, {}
    stream = files.open(_child(spark, path, f"{max(numbers)}.json"))
    try:
        return max(numbers), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, number: int, record: dict) -> None:
    """Commit a version: ``record`` is written aside and renamed to its number, which fails if that exists.

    Needs a file system whose rename is atomic and does not overwrite, such as HDFS. Raises
    ``VersionConflict`` where the number is taken; whatever the loser has written was never counted.
    """
    files, path = _file_system(spark, folder)
    files.mkdirs(path)
    aside, target = _child(spark, path, f".{number}-{uuid4().hex}"), _child(spark, path, f"{number}.json")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(record).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, options)
    except Py4JJavaError as error:
        files.delete(aside, False)
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise VersionConflict(f"version {number} of {folder} was committed by somebody else") from error
        raise


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(path)


def _child(spark: SparkSession, path, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path, name)
