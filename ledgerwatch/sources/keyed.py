"""Parquet tables with one row per key that streams write to in batches.

Rows lie in hash buckets of the key. A write adds its rows as a new version of the buckets that it touches and then names, in one
small commit file, the versions that make up each bucket; readers follow the newest commit, so they see all of a write or
nothing, whenever a job ends. A bucket with many versions is folded into one by the write that makes it too long: a read costs the same
however many writes came before. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION, BUCKET = "_version", "_bucket"


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A fold that keeps a key's row of the last write."""
    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, VERSION)]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), VERSION).alias("_row")).select(*keys, "_row.*")

    return fold


@dataclass
class KeyedTable:
    """``fold`` makes one row per key of the rows of several writes, which carry ``_version``; the last write wins if there is none.
    ``most`` versions of a bucket are read together; ``buckets`` is fixed by the first write."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 32
    fold: Callable[[DataFrame], DataFrame] | None = None
    most: int = 4

    def _fold(self, rows: DataFrame) -> DataFrame:
        return (self.fold or newest(list(self.keys)))(rows)

    def _files(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def commit(self) -> dict | None:
        """What the newest commit says: version, batch, schema, buckets and their versions."""
        fs, folder = self._files()
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return None
        with_text = self.spark._jvm.org.apache.commons.io.IOUtils
        stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, names[-1]))
        try:
            found = json.loads(with_text.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return found | {"of": {int(b): v for b, v in found["of"].items()}}

    def _publish(self, commit: dict) -> None:
        """The switch: a whole file gets its name at once, and a name is given once."""
        fs, folder = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = path(folder, f"draft-{commit['version']:012d}"), path(folder, f"{commit['version']:012d}.json")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(commit).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{final.toString()}: another writer was faster")

    def _write(self, rows: DataFrame, version: int) -> list[int]:
        """Rows as one version of their buckets, which are returned; what an ended attempt has left there is replaced."""
        folder = f"{self.path}/data/{VERSION}={version}"
        rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *self.keys).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        fs, _ = self._files()
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder)) if s.isDirectory())

    def _rows(self, commit: dict, buckets: list[int]) -> DataFrame:
        """Rows of some buckets as written, with ``_version`` and ``_bucket``: no other folder is listed."""
        schema = T.StructType.fromJson(commit["schema"]).add(VERSION, T.LongType()).add(BUCKET, T.IntegerType())
        folders = [f"{self.path}/data/{VERSION}={v}/{BUCKET}={b}" for b in buckets for v in commit["of"][b]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)

    def upsert(self, rows: DataFrame, batch: int | None = None) -> None:
        """Adds ``rows``, one per key. A ``batch`` that was committed before is not written again."""
        commit = self.commit()
        if commit is None:
            commit = {"version": -1, "batch": None, "buckets": self.buckets, "of": {}}
        if batch is not None and commit["batch"] is not None and batch <= commit["batch"]:
            return
        version = commit["version"] + 1
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(commit["buckets"])).cast("int")
        touched = self._write(rows.withColumn(BUCKET, bucket), version)
        of = commit["of"] | {b: [*commit["of"].get(b, []), version] for b in touched}
        commit = commit | {"version": version, "batch": commit["batch"] if batch is None else batch, "schema": json.loads(rows.schema.json()), "of": of}
        full = [b for b in touched if len(of[b]) > self.most]
        if full:
            version += 1
            folded = self._fold(self._rows(commit, full).drop(BUCKET)).withColumn(BUCKET, bucket)
            self._write(folded, version)
            commit = commit | {"version": version, "of": of | {b: [version] for b in full}}
        self._publish(commit)

    def read(self) -> DataFrame | None:
        """One row per key, or None before the first write. Buckets of one version are taken as they are."""
        commit = self.commit()
        if commit is None:
            return None
        single = [b for b, v in commit["of"].items() if len(v) == 1]
        several = [b for b, v in commit["of"].items() if len(v) > 1]
        rows = self._rows(commit, single).drop(VERSION, BUCKET)
        if not several:
            return rows
        return rows.unionByName(self._fold(self._rows(commit, several).drop(BUCKET)).select(*rows.columns))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes data and commits that none of the last ``keep`` commits names."""
        fs, folder = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        used, last = set(), self.commit()
        for name in names[-keep:]:
            stream = fs.open(path(folder, name))
            try:
                used |= {v for of in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["of"].values() for v in of}
            finally:
                stream.close()
        for status in fs.listStatus(path(f"{self.path}/data")):
            version = int(status.getPath().getName().split("=")[1])
            if version not in used and version <= last["version"]:
                fs.delete(status.getPath(), True)
        for name in names[:-keep]:
            fs.delete(path(folder, name), False)
