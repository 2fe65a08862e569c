"""Snapshot store: Parquet directories per table version, and a manifest that is replaced as a whole.

A commit writes new directories for the tables it changes and then flips the manifest with an atomic rename, so a reader sees all
of a commit or none of it, and a failed commit leaves nothing but unreferenced directories. A change is a whole table or a delta: rows, and
keys whose older rows they replace. A delta writes its own rows only; reading resolves all deltas of a table in one join, and ``compact``
turns them into a whole table again. The root is a folder that driver and executors share; the manifest is read and written by the
driver alone, under a file lock.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewise.plans.schema import SCHEMA_HASH, SINGLES, TABLES, struct


class StoreLocked(RuntimeError):
    """Another run holds the lock."""


@dataclass(frozen=True)
class Delta:
    """Rows of a table, and the values of its first key column whose rows from before go."""

    rows: DataFrame
    keys: DataFrame


class Store:
    def __init__(self, root: str | Path):
        if not str(root).strip():
            raise ValueError("the store's path is empty")
        self.root = Path(root).expanduser().resolve()

    @property
    def exists(self) -> bool:
        return (self.root / "manifest.json").is_file()

    def manifest(self) -> dict[str, Any]:
        if not self.exists:
            return {"version": 0, "schema_hash": SCHEMA_HASH, "tables": {}, "singles": {}}
        return json.loads((self.root / "manifest.json").read_text(encoding="utf-8"))

    @contextlib.contextmanager
    def lock(self, name: str = "write") -> Iterator[None]:
        """Exclusive among processes; raises ``StoreLocked`` at once if it is taken."""
        self.root.mkdir(parents=True, exist_ok=True)
        with (self.root / f"{name}.lock").open("w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise StoreLocked(f"{self.root} is in use by another process") from e
            yield

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of the current version; one that was never written is empty."""
        manifest = self.manifest()
        if name in SINGLES:
            row = {"schema_hash": manifest["schema_hash"]} if name == "schema_meta" else manifest["singles"].get(name)
            schema = struct(name)
            return spark.createDataFrame([] if row is None else [tuple(_from_json(row.get(f.name), f.dataType.typeName()) for f in schema.fields)], schema)
        schema, folder, deltas = struct(name), manifest["tables"].get(name), manifest.get("deltas", {}).get(name, [])
        whole = spark.read.schema(schema).parquet(self._url(folder)) if folder else spark.createDataFrame([], schema)
        if not deltas:
            return whole
        key = TABLES[name][1][0]
        made = F.col("made_").cast("int")
        later = spark.read.schema(f"{schema.simpleString()[7:-1].replace(':', ' ')}, made_ int").parquet(*(self._url(f"{d}/rows") for d in deltas))
        gone = spark.read.schema(f"{key} {schema[key].dataType.simpleString()}, made_ int").parquet(*(self._url(f"{d}/keys") for d in deltas))
        gone = gone.groupBy(key).agg(F.max(made).alias("gone_"))
        rows = whole.withColumn("made_", F.lit(0)).unionByName(later).join(gone, key, "left")
        return rows.where(F.col("gone_").isNull() | (F.col("made_") >= F.col("gone_"))).select(*schema.names)

    def _url(self, folder: str) -> str:
        return f"file://{self.root / folder}"

    def deltas(self) -> int:
        """The number of deltas of the table that has most."""
        return max(map(len, self.manifest().get("deltas", {}).values()), default=0)

    def compact(self, spark: SparkSession) -> None:
        """Make whole tables of those with deltas."""
        names = [n for n, d in self.manifest().get("deltas", {}).items() if d]
        if names:
            self.commit({n: self.read(spark, n) for n in names})

    def upgrade(self, spark: SparkSession) -> bool:
        """Rewrite a store of another schema: columns that are new are null, those that are gone go. Whether there was anything to do."""
        if self.manifest()["schema_hash"] == SCHEMA_HASH:
            return False
        known = [n for n in self.manifest()["tables"] if n in TABLES]
        self.commit({n: self.read(spark, n) for n in known})
        return True

    def commit(self, changes: dict[str, DataFrame | Delta], singles: dict[str, dict[str, Any] | None] | None = None, merge_singles: bool = False) -> int:
        """Write the changed tables, check their keys, then flip the manifest. The new version's number."""
        with self.lock():
            before = self.manifest()
            after = before | {"version": before["version"] + 1, "schema_hash": SCHEMA_HASH, "tables": dict(before["tables"]), "singles": dict(before["singles"]), "deltas": dict(before.get("deltas", {}))}
            made: list[Path] = []
            try:
                for name, change in changes.items():
                    folder = f"{name}/{after['version']:08d}-{uuid.uuid4().hex[:8]}"
                    made.append(self.root / folder)
                    if isinstance(change, Delta):
                        key = TABLES[name][1][0]
                        number = F.lit(after["version"]).alias("made_")
                        change.keys.select(key, number).distinct().coalesce(1).write.parquet(self._url(f"{folder}/keys"))
                        _of(name, change.rows).withColumn("made_", number).coalesce(1).write.parquet(self._url(f"{folder}/rows"))
                        self._check(change.rows.sparkSession, name, f"{folder}/rows")
                        after["deltas"][name] = [*after["deltas"].get(name, []), folder]
                    else:
                        _of(name, change).write.parquet(self._url(folder))
                        self._check(change.sparkSession, name, folder)
                        after["tables"][name] = folder
                        after["deltas"].pop(name, None)
            except Exception:
                for folder in made:
                    shutil.rmtree(folder, ignore_errors=True)
                raise
            for name, row in (singles or {}).items():
                if row is None:
                    after["singles"].pop(name, None)
                else:
                    after["singles"][name] = {**(after["singles"].get(name) or {} if merge_singles else {}), **{k: _to_json(v) for k, v in row.items()}}
            temporary = self.root / f"manifest.{uuid.uuid4().hex}"
            temporary.write_text(json.dumps(after, ensure_ascii=False, indent=1), encoding="utf-8")
            os.replace(temporary, self.root / "manifest.json")
            return after["version"]

    def _check(self, spark: SparkSession, name: str, folder: str) -> None:
        key = TABLES[name][1]
        written = spark.read.schema(struct(name)).parquet(self._url(folder))
        bad = written.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in key), F.lit(0)).cast("boolean")).limit(3).collect()
        if bad:
            raise ValueError(f"{name}: key {', '.join(key)} is null or repeated: {[tuple(r)[:-1] for r in bad]}")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove directories of versions older than the last ``keep`` that the manifest doesn't name."""
        with self.lock():
            manifest, gone = self.manifest(), []
            for name in TABLES:
                for folder in (self.root / name).glob("*"):
                    used = [manifest["tables"].get(name), *manifest.get("deltas", {}).get(name, [])]
                    if f"{name}/{folder.name}" not in used and int(folder.name.split("-")[0]) <= manifest["version"] - keep:
                        shutil.rmtree(folder)
                        gone.append(f"{name}/{folder.name}")
            return gone

    def delete(self) -> None:
        if not self.exists:
            raise FileNotFoundError(f"No store at {self.root}")
        shutil.rmtree(self.root)


def _of(name: str, df: DataFrame) -> DataFrame:
    """The columns of a table, with its types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in struct(name).fields))


def _to_json(value: Any) -> Any:
    return value.isoformat(sep=" ") if isinstance(value, datetime) else value


def _from_json(value: Any, kind: str) -> Any:
    return datetime.fromisoformat(value) if value is not None and kind == "timestamp_ntz" else value
