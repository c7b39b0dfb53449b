"""Versions of a bundle: table folders that are never changed, and a commit file a version, written last.

A bundle is what its newest commit names. A writer puts new tables into folders of their own, then adds the commit; until
then readers see the version before, and a writer stopped at any step changes nothing. The commit's name holds its number
and is created only if it isn't there, so of two writers one fails. Nothing is renamed, which object stores don't do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

COMMITS, DATA = "versions", "data"


@dataclass(frozen=True)
class Version:
    """A number and the folders of the tables, relative to the bundle."""

    number: int
    tables: dict[str, str] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has committed in the meantime."""


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the class of its paths."""
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def exists(spark: SparkSession, path: str) -> bool:
    fs, kind = _fs(spark, path)
    return fs.exists(kind(path))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, kind = _fs(spark, path)
    folder = kind(f"{path}/{COMMITS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _file(path: str, number: int) -> str:
    return f"{path}/{COMMITS}/{number:012d}.json"


def _read(spark: SparkSession, path: str, number: int) -> Version | None:
    """A commit; None if its writer was stopped before it was whole."""
    fs, kind = _fs(spark, path)
    stream = fs.open(kind(_file(path, number)))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return Version(number, dict(json.loads(text)["tables"]))
    except (ValueError, KeyError):
        return None


def latest(spark: SparkSession, path: str) -> Version | None:
    """The newest whole version, or None where the folder has none."""
    for number in reversed(_numbers(spark, path)):
        if (found := _read(spark, path, number)) is not None:
            return found
    return None


def locate(spark: SparkSession, path: str, name: str, version: Version | None = None) -> str | None:
    """Where a table of a bundle lies: as its version says, or under its plain name in a folder without versions."""
    version = version or latest(spark, path)
    if version is not None:
        return f"{path}/{version.tables[name]}" if name in version.tables else None
    return f"{path}/{name}" if exists(spark, f"{path}/{name}") else None


def publish(
    spark: SparkSession, path: str, writers: Mapping[str, Callable[[str], None]], keep: bool = True, plain: tuple[str, ...] = (),
) -> Version:
    """Write the given tables and commit them as one new version.

    ``writers`` maps a table's name to a function that writes it to a folder. With ``keep`` all other tables stay as they
    are in the version before; where there is none, those of ``plain`` that lie under their own names are taken over.
    """
    numbers = _numbers(spark, path)
    before = latest(spark, path)
    tables: dict[str, str] = {}
    if keep:
        tables = dict(before.tables) if before else {n: n for n in plain if exists(spark, f"{path}/{n}")}
    for name, write in writers.items():
        folder = f"{DATA}/{uuid.uuid4().hex}/{name}"
        write(f"{path}/{folder}")
        tables[name] = folder
    made = Version(numbers[-1] + 1 if numbers else 0, tables)
    _commit(spark, path, made)
    return made


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    fs, kind = _fs(spark, path)
    target = kind(_file(path, version.number))
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        raise Conflict(f"version {version.number} of {path} is there already")
    try:
        stream = fs.create(target, False)
    except Exception as error:
        raise Conflict(f"version {version.number} of {path} was written by another") from error
    stream.write(bytearray(json.dumps({"tables": version.tables}).encode()))
    stream.close()


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove all but the newest ``keep`` versions, and the folders that only they name; gives how many versions went.

    Folders without any commit, of writers that were stopped or are still at work, stay.
    """
    whole = [v for n in _numbers(spark, path) if (v := _read(spark, path, n)) is not None]
    gone, kept = whole[: max(len(whole) - max(keep, 1), 0)], whole[max(len(whole) - max(keep, 1), 0) :]
    used = {folder for v in kept for folder in v.tables.values()}
    fs, kind = _fs(spark, path)
    for v in gone:
        fs.delete(kind(_file(path, v.number)), False)  # first, so that no commit names what is missing
        for folder in set(v.tables.values()) - used:
            fs.delete(kind(f"{path}/{folder}"), True)
    return len(gone)
