"""Sets of tables that appear whole or not at all.

The parts of a version are written first, each in a folder of its own that nothing else uses.
A small manifest that names them, with their row counts and schemas, is written last. Readers
go by manifests only, so a job that dies half-way leaves files that nobody reads, and the
version before stays in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "manifests"


class MissingVersion(FileNotFoundError):
    """No manifest, or not the wanted one."""


class BrokenVersion(RuntimeError):
    """A manifest names a part that is not there as it was written."""


@dataclass
class Version:
    """A published version: its parts as tables, and the note that came with them."""

    name: str
    number: int
    parts: dict[str, DataFrame] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _files(spark, path)
    return system.exists(at)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    system, at = _files(spark, path)
    return system.getContentSummary(at).getLength()


def _write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there; whether this call wrote it."""
    system, at = _files(spark, path)
    try:
        out = system.create(at, False)
    except Exception as error:
        if "AlreadyExists" in str(error) or "already exists" in str(error):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> str:
    system, at = _files(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    system, at = _files(spark, f"{path}/{MANIFESTS}")
    if not system.exists(at):
        return []
    names = [status.getPath().getName() for status in system.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def publish(
    spark: SparkSession,
    path: str,
    parts: Mapping[str, DataFrame],
    note: Mapping | None = None,
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> Version:
    """Write the parts, then the manifest; the version is the newest from then on.

    Two jobs that publish at once both succeed; the later manifest has the higher number.
    """
    name, described = uuid.uuid4().hex, {}
    for part, df in parts.items():
        folder = f"{path}/{name}/{part}"
        writer = df.write.option("compression", "zstd")
        by = (partition_by or {}).get(part, ())
        (writer.partitionBy(*by) if by else writer).parquet(folder)
        # Row counts come from the footers of the files.
        described[part] = {"rows": spark.read.schema(df.schema).parquet(folder).count(), "schema": df.schema.json()}
    body = json.dumps({"version": name, "parts": described, "note": dict(note or {})})
    number = max(_numbers(spark, path), default=0) + 1
    while not _write_once(spark, f"{path}/{MANIFESTS}/{number:012d}.json", body):
        number += 1
    return open_version(spark, path, number, check=False)


def open_version(spark: SparkSession, path: str, number: int | None = None, check: bool = True) -> Version:
    """The newest version under ``path``, or the one with the given number.

    Every part must be there with the rows that its manifest states.
    """
    known = _numbers(spark, path)
    if not known or (number is not None and number not in known):
        raise MissingVersion(f"no version {'' if number is None else number} under {path}")
    number = known[-1] if number is None else number
    try:
        body = json.loads(_read(spark, f"{path}/{MANIFESTS}/{number:012d}.json"))
        name, described, note = body["version"], body["parts"], body["note"]
    except (ValueError, KeyError) as error:
        raise BrokenVersion(f"manifest {number} under {path} cannot be read") from error
    found = Version(name, number, note=note)
    for part, facts in described.items():
        folder = f"{path}/{name}/{part}"
        if not exists(spark, f"{folder}/_SUCCESS"):
            raise BrokenVersion(f"part {part} of version {number} under {path} is missing")
        found.parts[part] = spark.read.schema(T.StructType.fromJson(json.loads(facts["schema"]))).parquet(folder)
        if check and found.parts[part].count() != facts["rows"]:
            raise BrokenVersion(f"part {part} of version {number} under {path} has lost rows")
    return found
