"""Versioned snapshots of a table, with compare-and-set commits.

A save writes its rows to a folder of its own and then claims the next version by a commit file that
must not exist yet. Of two writers that start from one version one claims it; the other gets a
Conflict and its rows are removed. Readers follow commit files only, so they never see a save that failed or has
not ended. Single values (settings, approvals) lie within the commit file itself.

Commit files appear whole or not at all: they are written under another name first, then linked (a local folder) or
renamed (any other file system), neither of which replaces a file that is there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has claimed the version."""


def _path(spark: SparkSession, *parts: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str, name: str) -> list[int]:
    folder, fs = _path(spark, root, name, "commits")
    if not fs.exists(folder):
        return []
    return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json") and n[0] != ".")


def latest(spark: SparkSession, root: str, name: str) -> int:
    """The newest version, 0 if there is none."""
    return max(_versions(spark, root, name), default=0)


def _read(spark: SparkSession, root: str, name: str, version: int) -> dict:
    path, fs = _path(spark, root, name, "commits", f"{version:010d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, root: str, name: str, version: int, body: dict) -> None:
    jvm = spark.sparkContext._jvm
    target, fs = _path(spark, root, name, "commits", f"{version:010d}.json")
    draft, _ = _path(spark, root, name, "commits", f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(body, ensure_ascii=False, sort_keys=True).encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            file = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("java.lang.String"), 0))
            try:
                jvm.java.nio.file.Files.createLink(file(target), file(draft))
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    raise Conflict(f"{name}: version {version} is taken") from None
                raise
        elif fs.exists(target) or not fs.rename(draft, target):
            raise Conflict(f"{name}: version {version} is taken")
    finally:
        fs.delete(draft, False)


def save(df: DataFrame, root: str, name: str, expected: int) -> int:
    """Writes df as the version after `expected`, which must be the newest; returns that version."""
    spark = df.sparkSession
    data = f"data-{uuid.uuid4().hex}"
    folder, fs = _path(spark, root, name, data)
    try:
        if latest(spark, root, name) != expected:
            raise Conflict(f"{name}: the newest version isn't {expected}")
        df.write.parquet(f"{root}/{name}/{data}")
        _commit(spark, root, name, expected + 1, {"data": data, "schema": df.schema.jsonValue()})
    except BaseException:
        fs.delete(folder, True)
        raise
    return expected + 1


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version (default: the newest), None if there is none."""
    from pyspark.sql.types import StructType

    version = version or latest(spark, root, name)
    if version not in _versions(spark, root, name):
        return None
    body = _read(spark, root, name, version)
    return spark.read.schema(StructType.fromJson(body["schema"])).parquet(f"{root}/{name}/{body['data']}")


def save_value(spark: SparkSession, root: str, name: str, value, expected: int) -> int:
    """Claims the version after `expected` for a JSON value."""
    if latest(spark, root, name) != expected:
        raise Conflict(f"{name}: the newest version isn't {expected}")
    _commit(spark, root, name, expected + 1, {"value": value})
    return expected + 1


def load_value(spark: SparkSession, root: str, name: str, default=None):
    """The newest value, or the default where none was saved."""
    version = latest(spark, root, name)
    return _read(spark, root, name, version)["value"] if version else default


def prune(spark: SparkSession, root: str, name: str, keep: int = 1) -> None:
    """Removes all but the newest versions, and rows that no commit names."""
    versions = _versions(spark, root, name)
    for v in versions[: max(0, len(versions) - keep)]:
        path, fs = _path(spark, root, name, "commits", f"{v:010d}.json")
        fs.delete(path, False)
    used = {_read(spark, root, name, v).get("data") for v in _versions(spark, root, name)}
    folder, fs = _path(spark, root, name)
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        if s.getPath().getName().startswith("data-") and s.getPath().getName() not in used:
            fs.delete(s.getPath(), True)
