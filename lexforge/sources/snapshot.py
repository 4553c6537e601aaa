"""A library in versions: each version is a folder of Parquet tables with a manifest, and a pointer names the current one.

Readers see a whole version or the one before; a version is published by one rename of the pointer. All paths go through
Spark's file systems, so a library may lie in any store that Spark reaches.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.mutations import violations

FORMAT = 1
SCHEMA_VERSION = 8
APP_VERSION = "0.1.0"
#: Columns that a version of the schema added, with their types: older tables get them as nulls.
ADDED = {"books": [(8, "file_hash", "string")], "bookmarks": [(3, "folder_id", "bigint")]}


class BadSnapshot(ValueError):
    """A snapshot that is not one, or is of a later version, or is damaged."""


class Files:
    """The few calls of a file system that snapshots need."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        p = self.path(name)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside, then renamed over what is there, in one step: a reader sees the old text or the new one."""
        part = f"{name}.{uuid.uuid4().hex}.partial"
        stream = self.fs.create(self.path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        over = self.gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(self.path(part)), self.fs.makeQualified(self.path(name)), over)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))


class Library:
    """A folder of versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def current(self) -> str | None:
        text = self.files.read("CURRENT")
        return text.strip() if text else None

    def manifest(self, version: str | None = None) -> dict:
        name = version or self.current()
        text = self.files.read(f"{name}/manifest.json") if name else None
        if text is None:
            raise BadSnapshot("there is no such version")
        try:
            found = json.loads(text)
        except ValueError as e:
            raise BadSnapshot("the manifest cannot be read") from e
        if found.get("format") != FORMAT:
            raise BadSnapshot(f"format {found.get('format')}")
        if found["schema_version"] > SCHEMA_VERSION:
            raise BadSnapshot("it was made by a later version")
        return found

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write a version and make it the current one. Rows are counted on what was written."""
        version = f"v-{datetime.now(UTC).strftime('%Y%m%d%H%M%S%f')}-{uuid.uuid4().hex[:8]}"
        counts = {}
        for name, t in tables.items():
            t.write.parquet(f"{self.root}/{version}/{name}")
            kept = self.spark.read.schema(t.schema).parquet(f"{self.root}/{version}/{name}")
            row = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*kept.columns).cast("decimal(38,0)")).alias("s")).first()
            counts[name] = {"rows": row["n"], "checksum": str(row["s"] or 0)}
        made = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        text = json.dumps({"format": FORMAT, "app_version": APP_VERSION, "schema_version": SCHEMA_VERSION, "created_at": made, "tables": counts, "schemas": {n: json.loads(t.schema.json()) for n, t in tables.items()}})
        self.files.write(f"{version}/manifest.json", text)
        self.publish(version)
        return version

    def prune(self, keep: int = 2) -> list[str]:
        """Deletes all but the last versions; the current one stays in any case. Which went."""
        names = sorted(s.getPath().getName() for s in self.files.fs.listStatus(self.files.path("")) if s.getPath().getName().startswith("v-"))
        gone = [n for n in names[: max(0, len(names) - keep)] if n != self.current()]
        for n in gone:
            self.files.fs.delete(self.files.path(n), True)
        return gone

    def publish(self, version: str) -> None:
        self.files.write("CURRENT", version)

    def read(self, name: str, version: str | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        found = self.manifest(version)
        if name not in found["tables"]:
            raise BadSnapshot(f"there is no table {name}")
        at = version or self.current()
        t = self.spark.read.schema(StructType.fromJson(found["schemas"][name])).parquet(f"{self.root}/{at}/{name}")
        for since, column, kind in ADDED.get(name, []):
            if found["schema_version"] < since and column not in t.columns:
                t = t.withColumn(column, F.lit(None).cast(kind))
        return t

    def tables(self, version: str | None = None) -> dict[str, DataFrame]:
        return {n: self.read(n, version) for n in self.manifest(version)["tables"]}

    def verify(self, version: str | None = None) -> None:
        """Rows and checksums of all tables are those of the manifest, and no rule of the library is broken."""
        found = self.manifest(version)
        own = self.tables(version)
        for name, t in own.items():
            try:
                row = t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")).alias("s")).first()
            except Exception as e:
                raise BadSnapshot(f"{name} cannot be read") from e
            if (row["n"], str(row["s"] or 0)) != (found["tables"][name]["rows"], found["tables"][name]["checksum"]):
                raise BadSnapshot(f"{name} is damaged")
        if {"books", "chapters", "blocks"} & set(own):
            broken = violations(own).collect()
            if broken:
                raise BadSnapshot("; ".join(f"{r['rule']}: {r['n']}" for r in broken))

    def backup(self, target: str) -> dict:
        """A copy of the current version in another folder."""
        if target.rstrip("/") == self.root:
            raise BadSnapshot("a library is no backup of itself")
        copy = Library(self.spark, target)
        copy.write(self.tables())
        return copy.manifest()

    def restore(self, source: str) -> dict:
        """The tables of a backup, checked first, as a new current version; the version before stays, and can be published
        again."""
        other = Library(self.spark, source)
        if other.current() is None:
            raise BadSnapshot("not a backup")
        other.verify()
        self.write(other.tables())
        return {n: t["rows"] for n, t in self.manifest()["tables"].items()}
