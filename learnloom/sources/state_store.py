"""Learner state that a stream keeps on disk: versions of several tables that change together.

A commit writes the changed rows of every table to a folder of its own and then a manifest that
lists the folders of the version; readers only follow manifests. So a version is there as a whole or
not at all: a run that dies between two tables leaves nothing that is read, and a batch that is run
again finds its version and does nothing. After ``merge_after`` folders the next commit writes all
rows anew, one per key, as the snapshot that later changes refer to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from learnloom.session import delete_path

VERSION = "_version"


class StateStore:
    """Tables with a key each under ``path``; the newest version of a key is its row.

    One writer commits at a time (a stream has one). Each commit has one row per key.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]], merge_after: int = 8):
        self.spark, self.path, self.keys, self.merge_after = spark, path.rstrip("/"), keys, merge_after
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name.split(".")[0]) for name in names if name.endswith(".json") and name[0] != ".")

    def _manifest(self, version: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).collect()  # one small file
        return json.loads(rows[0].value)

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest appears under its name with all it holds, or not at all."""
        draft = self._hadoop.Path(f"{self.path}/manifests/.{version:012d}.{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._files.rename(draft, self._hadoop.Path(f"{self.path}/manifests/{version:012d}.json")):
            self._files.delete(draft, False)
            raise FileExistsError(f"version {version} of {self.path} was written by another run")

    def commit(self, version: int, tables: dict[str, DataFrame]) -> bool:
        """Store the changed rows as ``version``; False where it or a later one is there already."""
        if set(tables) != set(self.keys):
            raise ValueError(f"a version has the tables {sorted(self.keys)}")
        known = self.versions()
        if known and version <= known[-1]:
            return False
        before = self._manifest(known[-1]) if known else {"folders": [], "schemas": {}}
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.withColumn(VERSION, F.lit(version).cast("long")).write.parquet(f"{self.path}/{folder}/{name}")
        schemas = {name: table.withColumn(VERSION, F.lit(0).cast("long")).schema.jsonValue() for name, table in tables.items()}
        manifest = {"folders": [*before["folders"], folder], "schemas": schemas}
        if len(manifest["folders"]) > self.merge_after:
            merged = f"data/{version:012d}-{uuid.uuid4().hex}"
            for name in self.keys:
                self._rows(name, manifest).write.parquet(f"{self.path}/{merged}/{name}")
            manifest["folders"] = [merged]
        self._publish(version, manifest)
        return True

    def _rows(self, name: str, manifest: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(manifest["schemas"][name])
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}/{name}" for folder in manifest["folders"]])
        keys = self.keys[name]
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), VERSION).alias("_row")).select(*keys, "_row.*")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """Rows of a table at a version, by default the last."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            raise LookupError(f"no version in {self.path}")
        return self._rows(name, self._manifest(known[-1])).drop(VERSION)

    def vacuum(self) -> int:
        """Delete earlier versions and what broken runs have left; returns the folders deleted."""
        known = self.versions()
        kept = set(self._manifest(known[-1])["folders"]) if known else set()
        folder = self._hadoop.Path(f"{self.path}/data")
        names = [f"data/{s.getPath().getName()}" for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        gone = [name for name in names if name not in kept]
        for version in known[:-1]:
            delete_path(self.spark, f"{self.path}/manifests/{version:012d}.json")
        for name in gone:
            delete_path(self.spark, f"{self.path}/{name}")
        return len(gone)
