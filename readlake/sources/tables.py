"""Tables in hash buckets with a manifest for each version: an upsert rewrites the buckets that it touches, and no others.

A folder holds data/v=N/bucket=K (the files that version N wrote) and manifests/N.json, which says for every bucket which version's
files hold it.  Files are written first and the manifest is put in place by one rename, so a version is there whole or not at all;
what a lost driver wrote before that is overwritten when the version is tried again.  A manifest has an entry a bucket, for any table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketedTable:
    """A table of rows with keys; rows of equal keys lie in one of a fixed number of buckets."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), [*keys], buckets

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def versions(self) -> list[int]:
        """Versions that are there, ascending."""
        fs, path = self._place("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "._")

    def manifest(self, version: int) -> dict[int, int]:
        """For each bucket with rows the version whose files hold it."""
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first().value
        found = json.loads(text)
        if found["buckets"] != self.buckets or found["keys"] != self.keys:
            raise ValueError(f"{self.path} has {found['buckets']} buckets by {found['keys']}")
        return {int(k): v for k, v in found["held"].items()}

    def _read(self, held: dict[int, int]) -> DataFrame | None:
        if not held:
            return None
        paths = [f"{self.path}/data/v={v}/bucket={k}" for k, v in sorted(held.items())]
        return self.spark.read.parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a version, by default the latest; None for a table without rows."""
        there = self.versions()
        if version is None and not there:
            return None
        return self._read(self.manifest(there[-1] if version is None else version))

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], version: int) -> None:
        """Make a version by merge(rows before, batch), which must treat each key by itself and keep its columns; a version that is there stays.

        Only buckets with keys of the batch are read and written.  A bucket whose rows all go is left out of the manifest.
        """
        there = self.versions()
        if version in there:
            return
        held = self.manifest(max(v for v in there if v < version)) if any(v < version for v in there) else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect())  # as many as buckets at most
        merged = merge(self._read({k: held[k] for k in touched if k in held}), batch).withColumn("bucket", bucket)
        written = f"{self.path}/data/v={version}"
        merged.repartition(max(len(touched), 1), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(written)
        fs, path = self._place(f"data/v={version}")
        full = {int(f.getPath().getName().removeprefix("bucket=")) for f in fs.listStatus(path) if f.isDirectory()}
        held = {k: v for k, v in held.items() if k not in touched} | dict.fromkeys(full, version)
        self._commit(version, json.dumps({"keys": self.keys, "buckets": self.buckets, "held": held}))

    def _commit(self, version: int, text: str) -> None:
        fs, draft = self._place(f"manifests/.{version}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(draft, self._place(f"manifests/{version}.json")[1]):
            raise OSError(f"version {version} of {self.path} could not be put in place")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what only versions before the last ones hold."""
        there = self.versions()
        used = {v for n in there[-keep:] for v in self.manifest(n).values()}
        for n in there[:-keep]:
            fs, path = self._place(f"manifests/{n}.json")
            fs.delete(path, False)
        fs, path = self._place("data")
        for name in [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []:
            if int(name.removeprefix("v=")) < there[-1] and int(name.removeprefix("v=")) not in used:
                fs.delete(self._place(f"data/{name}")[1], True)
