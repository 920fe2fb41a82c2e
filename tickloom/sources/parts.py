"""Parquet tables in buckets of their keys: a merge rewrites the touched buckets only, and a manifest publishes it.

A table is a folder with ``data``, where every write puts new files, and
``manifests``, where ``v<n>.json`` names the folder of each bucket in version
``n``.  Nothing is changed in place.  A version comes to be when its manifest,
written aside, is renamed to a name that must not exist: readers see the version
before or the one after, and of two writers one is told that the other was
faster.  A write that fails before leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.sources.merge import merged

#: The folder of a bucket is <PART>=<number>.
PART = "part_of_key"
ATTEMPTS = 3


class ConcurrentWrite(RuntimeError):
    """Another writer published the version that this one was about to."""


class PartTable:
    """A table at ``path``; ``keys`` tell rows apart, ``by`` (some of them) decide the bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._folder = self._at(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    # -- versions ------------------------------------------------------------
    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            found = self.versions()
            if not found:
                raise FileNotFoundError(f"no table at {self.path}")
            version = found[-1]
        stream = self._files.open(self._at(f"{self.path}/manifests/v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> int:
        aside = f"{self.path}/manifests/.{uuid.uuid4().hex}"
        stream = self._files.create(self._at(aside))
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._at(aside), self._at(f"{self.path}/manifests/v{manifest['version']}.json"), none)
        except Py4JJavaError as e:
            self._files.delete(self._at(aside), False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise ConcurrentWrite(f"version {manifest['version']} of {self.path} is there already") from None
            raise
        return manifest["version"]

    def read(self, version: int | None = None) -> DataFrame:
        return self._parts(self.manifest(version))

    def _parts(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{p}" for bucket, p in manifest["parts"].items() if only is None or bucket in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # -- writes --------------------------------------------------------------
    def _bucket(self, by: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, by: list[str], buckets: int) -> dict[str, str]:
        """The folder of every bucket that ``rows`` fill."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PART, self._bucket(by, buckets)).repartition(F.col(PART)).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(f"{self.path}/{folder}"))]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{PART}=")}

    def create(self, rows: DataFrame, keys: list[str], by: list[str] | None = None, buckets: int = 64) -> int:
        """The first version.  ``buckets`` fixes the grain of later merges: a bucket is written by one task."""
        by = by or keys
        if not set(by) <= set(keys):
            raise ValueError("buckets are made of keys")
        parts = self._write(rows, by, buckets)
        return self._publish({"version": 1, "keys": keys, "by": by, "buckets": buckets, "schema": rows.schema.jsonValue(), "parts": parts, "tag": None})

    def _change(self, make: Callable[[dict], dict]) -> int:
        """Publish what ``make`` does to the newest manifest, anew if another writer comes first."""
        for left in range(ATTEMPTS, 0, -1):
            old = self.manifest()
            new = make(old)
            if new is old:
                return old["version"]
            try:
                return self._publish({**new, "version": old["version"] + 1})
            except ConcurrentWrite:
                if left == 1:
                    raise
        raise AssertionError

    def _touched(self, rows: DataFrame, m: dict) -> set[str]:
        """Numbers of the buckets that ``rows`` fall into: at most as many as there are buckets."""
        return {str(r[0]) for r in rows.select(self._bucket(m["by"], m["buckets"])).distinct().collect()}

    def upsert(self, updates: DataFrame, evolve: bool = False, tag: list | None = None) -> int:
        """Rows of ``updates`` replace those of equal keys, others are added; of updates of one key any one counts.

        ``tag`` names a stream and its batch: a batch that the table has taken
        already is left out, so a stream may repeat it.
        """

        def make(m: dict) -> dict:
            if tag and m["tag"] and m["tag"][0] == tag[0] and m["tag"][1] >= tag[1]:
                return m
            touched = self._touched(updates, m)
            rows = merged(self._parts(m, touched), updates, m["keys"], evolve)
            parts = self._write(rows, m["by"], m["buckets"]) if touched else {}
            return {**m, "schema": rows.schema.jsonValue(), "parts": m["parts"] | parts, "tag": tag or m["tag"]}

        return self._change(make)

    def replace_keys(self, rows: DataFrame) -> int:
        """All rows that share ``by`` with one of ``rows`` go, and ``rows`` come: delete and insert as one change."""

        def make(m: dict) -> dict:
            touched = self._touched(rows, m)
            old = self._parts(m, touched)
            names = rows.select(*[F.col(k).alias(f"_new_{k}") for k in m["by"]]).distinct()
            same = F.lit(True)
            for k in m["by"]:
                same &= F.col(k).eqNullSafe(F.col(f"_new_{k}"))
            kept = old.join(names, same, "left_anti").unionByName(rows.select(*old.columns))
            # A touched bucket has rows after this too: each of them holds one of the new rows.
            return {**m, "parts": m["parts"] | self._write(kept, m["by"], m["buckets"])}

        return self._change(make)

    def reload(self, rows: DataFrame, floor: Column | None = None) -> int:
        """``rows`` in place of all rows, or of those for which ``floor`` holds (say, the last days)."""

        def make(m: dict) -> dict:
            kept = rows if floor is None else self._parts(m).where(~F.coalesce(floor, F.lit(False))).unionByName(rows.where(floor), allowMissingColumns=True)
            return {**m, "schema": kept.schema.jsonValue(), "parts": self._write(kept, m["by"], m["buckets"])}

        return self._change(make)

    def rollback(self, version: int) -> int:
        """A new version with the content of an earlier one."""
        return self._change(lambda m: {**self.manifest(version), "version": m["version"], "tag": m["tag"]})

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests of all but the last ``keep`` versions and the files that no kept one names; returns how many write folders went.

        A version must not be read any more when it goes, and no write may be under way.
        """
        found = self.versions()
        live = {p.split("/")[1] for v in found[-keep:] for p in self.manifest(v)["parts"].values()}
        for v in found[:-keep]:
            self._files.delete(self._at(f"{self.path}/manifests/v{v}.json"), False)
        gone = [s.getPath() for s in self._files.listStatus(self._at(f"{self.path}/data")) if s.getPath().getName() not in live]
        for p in gone:
            self._files.delete(p, True)
        return len(gone)


def put(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], by: list[str] | None = None, buckets: int = 64, tag: list | None = None) -> int:
    """Upsert into the table at ``path``, which comes to be with its first rows."""
    table = PartTable(spark, path)
    if not table.exists():
        try:
            table.create(rows.limit(0), keys, by, buckets)
        except ConcurrentWrite:
            pass  # another writer made it
    return table.upsert(rows, tag=tag)
