"""Output that appears as a whole: staged beside the old one, then made current or thrown away.

Two kinds of output share one interface.  ``renamed`` swaps a plain folder by renames, for file systems where a
rename is one cheap step.  ``versioned`` never moves or overwrites anything, so it also suits object stores: every
version is a folder of its own, and a version is current once an empty file that names it exists.  That file is
made last and as one step, so readers see the old version or the new one, and never none or half.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

STAGING = ".staging-"
PREVIOUS = ".previous-"
VERSIONS, POINTERS = "versions", "_current"
KEPT = 2


@dataclass(frozen=True)
class Staged:
    """A folder to write to, and what makes it current or removes it."""

    folder: str
    commit: Callable[[], None]
    abort: Callable[[], None]


Kind = Callable[[SparkSession, str], Staged]


def _files(spark: SparkSession, path: str):
    """(file system, function from a text to its path)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    fs, at = _files(spark, path)
    fs.delete(at(path), True)


def _abandon(fs, folder) -> None:
    """Remove what was staged; where that fails too, it stays unread, and the first error is the one to tell."""
    try:
        fs.delete(folder, True)
    except Py4JError:
        pass


def renamed(spark: SparkSession, path: str) -> Staged:
    """A plain folder at ``path``.  Between the two renames of a replacement there is no output for a moment."""
    fs, at = _files(spark, path)
    mark = uuid.uuid4().hex
    target = at(path)
    staging, previous = at(path.rstrip("/") + STAGING + mark), at(path.rstrip("/") + PREVIOUS + mark)

    def commit() -> None:
        had_old = fs.exists(target)
        if had_old and not fs.rename(target, previous):
            raise OSError(f"cannot replace {path}")
        if not fs.rename(staging, target):
            if had_old:
                fs.rename(previous, target)
            raise OSError(f"cannot publish {path}")
        if had_old:
            fs.delete(previous, True)

    return Staged(staging.toString(), commit, lambda: _abandon(fs, staging))


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed versions, the current one first."""
    base = path.rstrip("/")
    fs, at = _files(spark, path)
    pointers = at(f"{base}/{POINTERS}")
    if not fs.exists(pointers):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(pointers))
    return sorted((n for n in names if not n.startswith(".")), reverse=True)


def _folder(path: str, pointer: str) -> str:
    """The folder a pointer stands for: its name without the number."""
    return f"{path.rstrip('/')}/{VERSIONS}/{pointer.split('-')[1]}"


def current_path(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version of a ``versioned`` output; None before the first commit.

    A reader that holds the folder goes on reading it while newer versions appear, until ``KEPT`` of them have.
    """
    names = versions(spark, path)
    return _folder(path, names[0]) if names else None


def versioned(spark: SparkSession, path: str, kept: int = KEPT) -> Staged:
    """A new version below ``path``; the last ``kept`` versions stay readable.

    Pointers sort by a number one above the newest at commit; of two writers that commit at once with one number the greater
    name is current, for all readers alike.  What a lost writer staged has no pointer, so no reader meets it;
    ``remove_unpublished`` takes it away.
    """
    base, mark = path.rstrip("/"), uuid.uuid4().hex
    fs, at = _files(spark, path)
    folder = f"{base}/{VERSIONS}/{mark}"

    def commit() -> None:
        old = versions(spark, path)
        name = f"{int(old[0].split('-')[0]) + 1 if old else 1:012d}-{mark}"
        if not fs.createNewFile(at(f"{base}/{POINTERS}/{name}")):
            raise OSError(f"cannot publish {path}")
        for gone in old[max(kept, 1) - 1:]:
            fs.delete(at(f"{base}/{POINTERS}/{gone}"), True)
            fs.delete(at(_folder(path, gone)), True)

    return Staged(folder, commit, lambda: _abandon(fs, at(folder)))


def remove_unpublished(spark: SparkSession, path: str, age_ms: int) -> int:
    """Remove folders that no pointer names and that have not changed for ``age_ms``; returns how many there were."""
    base = path.rstrip("/")
    fs, at = _files(spark, path)
    folder = at(f"{base}/{VERSIONS}")
    if not fs.exists(folder):
        return 0
    named, now, gone = {n.split("-")[1] for n in versions(spark, path)}, spark._jvm.java.lang.System.currentTimeMillis(), 0
    for status in fs.listStatus(folder):
        if status.getPath().getName() not in named and now - status.getModificationTime() >= age_ms:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def publish(spark: SparkSession, path: str, write: Callable[[str], None], kind: Kind = renamed) -> None:
    """Write beside ``path`` and make it current on success; a failed job leaves the old output untouched.

    Spark's overwrite mode removes the old files before the job runs, so it is not used here.
    """
    staged = kind(spark, path)
    try:
        write(staged.folder)
    except Exception:
        staged.abort()
        raise
    staged.commit()
