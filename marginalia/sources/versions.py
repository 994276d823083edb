"""Tables that are replaced as a whole: a version is in force from the moment its commit record exists.

``path`` holds one small file per version, ``v<number>``, a JSON record that says which folders make up
the version; the folders lie next to it, below ``path.data``. A writer first writes its folders, then
creates the record of the next number, *only if there is none*: one call that a file system decides
for exactly one of several writers (an exclusive create; no folder is renamed, which object stores do
file by file). The others lose, leave their folders to be deleted, and get an error. A reader takes the
last record that is complete, so it sees all of a version or nothing of it. The version before the
newest is kept for readers that are still at work on it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DIGITS = 10


class Conflict(OSError):
    """Another writer has published the version first."""


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[1:]) for n in names if len(n) == DIGITS + 1 and n[0] == "v" and n[1:].isdigit())


def version_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/v{number:0{DIGITS}d}"


def record(spark: SparkSession, path: str, number: int) -> dict | None:
    """The commit record of a version; None while it is being written or when it is gone."""
    fs, at = _folder(spark, version_path(path, number))
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        raw = bytes(stream.readAllBytes())
    finally:
        stream.close()
    try:
        return json.loads(raw)
    except ValueError:
        return None


def last(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """Number and record of the version in force, (0, None) before the first."""
    for number in reversed(versions(spark, path)):
        found = record(spark, path, number)
        if found is not None:
            return number, found
    return 0, None


def commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Create the record of a version; ``Conflict`` if there is one."""
    fs, at = _folder(spark, version_path(path, number))
    fs.mkdirs(at.getParent())
    raw = json.dumps(content).encode()
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system checks, then creates
        try:
            handle = os.open(at.toUri().getPath(), os.O_WRONLY | os.O_CREAT | os.O_EXCL)
        except FileExistsError:
            raise Conflict(f"another writer has published {at}") from None
        with os.fdopen(handle, "wb") as f:
            f.write(raw)
        return
    try:
        stream = fs.create(at, False)
    except Exception as error:
        if fs.exists(at):
            raise Conflict(f"another writer has published {at}") from error
        raise
    stream.write(bytearray(raw))
    stream.close()


def data_path(path: str) -> str:
    """A fresh folder for files of a version."""
    return f"{path.rstrip('/')}.data/{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    fs, at = _folder(spark, folder)
    fs.delete(at, True)


def forget(spark: SparkSession, path: str, keep: int = 2, folders: Callable[[dict], set[str]] = lambda r: {r["folder"]}) -> None:
    """Delete the records before the last ``keep`` and the folders that only they name."""
    numbers = versions(spark, path)
    old = {n: record(spark, path, n) for n in numbers[:-keep]}
    used = set().union(*[folders(r) for n in numbers[-keep:] if (r := record(spark, path, n)) is not None])
    for number, content in old.items():
        for folder in folders(content) - used if content is not None else ():
            delete(spark, folder)
        delete(spark, version_path(path, number))


def latest(spark: SparkSession, path: str) -> str | None:
    """Folder of the version in force, or None."""
    content = last(spark, path)[1]
    return content["folder"] if content else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder, then make it the version in force. If the write fails or another
    writer was first, the former version stays and the folder goes."""
    number = (versions(spark, path) or [0])[-1]
    folder = data_path(path)
    try:
        write(folder)
        commit(spark, path, number + 1, {"folder": folder})
    except BaseException:
        delete(spark, folder)
        raise
    forget(spark, path)


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The version in force; with a schema, an empty table where there is none yet."""
    folder = latest(spark, path)
    if folder is None:
        if schema is None:
            raise FileNotFoundError(f"no version of {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(folder)
