"""Versioned artifacts: tables and facts of one run, which readers see as a whole or not at all.

A version's tables are written to a folder of its own. Then its manifest, which names that folder, is put in place under the
next number by a rename that replaces nothing: two writers can't take one number, and a reader that takes the highest
number sees a version whose tables are complete. Older versions stay readable until they are deleted. A claim is the same
with one number: the first writer's text stays, and later ones are told it.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _text(spark: SparkSession, path: str) -> str | None:
    fs, at = _place(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Whether `path`, which didn't exist, now holds `text`: written elsewhere and then renamed without replacing."""
    fs, at = _place(spark, path)
    draft = at.suffix(f".{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(draft, at, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" not in str(e):
            raise
        return False


def _run(root: str, kind: str, run: str) -> str:
    return f"{root.rstrip('/')}/{kind}/{run}"


def versions(spark: SparkSession, root: str, kind: str, run: str) -> list[int]:
    fs, at = _place(spark, f"{_run(root, kind, run)}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, root: str, kind: str, run: str, version: int | None = None) -> dict[str, Any] | None:
    """What was written with a version, by default the last; None if there is none."""
    known = versions(spark, root, kind, run)
    if not known or version not in (None, *known):
        return None
    text = _text(spark, f"{_run(root, kind, run)}/manifests/{version or known[-1]}.json")
    return json.loads(text) if text else None


def write(spark: SparkSession, root: str, kind: str, run: str, tables: dict[str, DataFrame], about: dict[str, Any] | None = None) -> dict[str, Any]:
    """The manifest of the run's next version: `about`, the version's number and where its tables are."""
    base = _run(root, kind, run)
    folder = f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{base}/{folder}/{name}")
    while True:
        version = max(versions(spark, root, kind, run), default=0) + 1
        made = {**(about or {}), "version": version, "tables": {name: f"{folder}/{name}" for name in tables}}
        if _put(spark, f"{base}/manifests/{version}.json", json.dumps(made, sort_keys=True)):
            return made


def read(spark: SparkSession, root: str, kind: str, run: str, table: str, version: int | None = None) -> DataFrame:
    found = manifest(spark, root, kind, run, version)
    if found is None or table not in found["tables"]:
        raise FileNotFoundError(f"no {table} of {kind} {run}")
    return spark.read.parquet(f"{_run(root, kind, run)}/{found['tables'][table]}")


def delete(spark: SparkSession, root: str, kind: str, run: str) -> bool:
    """Whether there was anything: manifests go first, so that no reader is led to tables that are going."""
    fs, at = _place(spark, _run(root, kind, run))
    there = fs.exists(at)
    for part in ("manifests", "data"):
        fs.delete(_place(spark, f"{_run(root, kind, run)}/{part}")[1], True)
    fs.delete(at, True)
    return there


def claim(spark: SparkSession, root: str, key: str, facts: dict[str, Any]) -> tuple[bool, dict[str, Any]]:
    """(whether this call was the first, the facts that stand) of a key that can be used once, such as a lock-box."""
    path = f"{root.rstrip('/')}/claims/{key}.json"
    first = _put(spark, path, json.dumps(facts, sort_keys=True))
    return first, json.loads(_text(spark, path))
