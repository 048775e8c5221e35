"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder: ``shards/`` holds Parquet files that are never changed, ``manifests/v=N`` lists
the shards that make up version N. Arrivals are appended as they come, in small shards. Compaction
puts shards into tiers by size and merges a tier once it holds enough of them, into files of about
the target size. A version is committed by one rename that fails if that version exists, so readers
see the old list or the new one, and of two writers one wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay readable after a vacuum, and commits that are tried against other writers.
KEEP, RETRIES = 2, 5
#: What a manifest says of each shard.
MANIFEST = "path string, bytes long, n_rows long, since long"


class ShardStore:
    """Shards of one table under ``root``, on a file system whose rename is atomic and never replaces.

    Paths of a tier and of a version are listed on the driver, as a read of files needs: some bytes for
    each file of the target size.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, least_bytes: int = 1 << 20):
        self.spark, self.root, self.target, self.fan_in, self.least = spark, root.rstrip("/"), target_bytes, fan_in, least_bytes
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        top = self._path(f"{self.root}/manifests")
        if not self._fs.exists(top):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(top)]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, by default the newest; none before the first commit."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/v={version or found[-1]}")

    def commit(self, manifest: DataFrame, version: int) -> int:
        """Make ``manifest`` version ``version``; FileAlreadyExistsException if another writer was first."""
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        manifest.coalesce(1).write.parquet(draft)  # one short row for each shard, which readers list in one go
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        how = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        how[0] = self._rename.NONE
        self._context.rename(self._path(draft), self._path(f"{self.root}/manifests/v={version}"), how)
        return version

    def _write(self, df: DataFrame, since: int) -> DataFrame:
        """Write new shards; their manifest rows."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        files = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        return files.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("since", F.lit(since).cast("long"))

    def _next(self, made: Callable[[int], DataFrame]) -> int:
        """Commit what ``made`` says of the version after the newest, again if another writer was first."""
        for _ in range(RETRIES):
            newest = (self.versions() or [0])[-1]
            try:
                return self.commit(made(newest), newest + 1)
            except Exception as lost:
                if "exists" not in str(lost):
                    raise
        raise RuntimeError(f"lost to other writers {RETRIES} times")

    def append(self, df: DataFrame) -> int:
        """Commit a version that also has the rows of ``df``, in shards of its own: one for each task."""
        new = self._write(df, (self.versions() or [0])[-1] + 1)
        return self._next(lambda newest: self.manifest(newest).unionByName(new) if newest else new)

    def tiers(self) -> DataFrame:
        """The newest manifest with each shard's tier; null for shards that are large enough."""
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") / self.least) / F.log(F.lit(float(self.fan_in)))))
        return self.manifest().withColumn("tier", F.when(F.col("bytes") * 2 < self.target, tier.cast("int")))

    def compact(self) -> int:
        """Merge tiers of at least ``fan_in`` shards, smallest first, until none is left; merges made.

        The rows of merged shards are read and written without a shuffle: neighbouring input splits
        go to one output file of about the target size.
        """
        made_merges = 0
        while True:
            tiers = self.tiers()
            full = tiers.where("tier is not null").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.collect_list("path").alias("paths")).where(F.col("n") >= self.fan_in).orderBy("tier").limit(1).collect()
            if not full:
                return made_merges
            version = self.versions()[-1] + 1
            merged = self._write(self.spark.read.parquet(*full[0]["paths"]).coalesce(max(1, round(full[0]["bytes"] / self.target))), version)
            gone = full[0]["paths"]

            def made(newest, merged=merged, gone=gone):
                now = self.manifest(newest)
                if now.where(F.col("path").isin(gone)).count() < len(gone):
                    raise RuntimeError("another writer merged these shards")
                return now.where(~F.col("path").isin(gone)).unionByName(merged)

            self._next(made)
            made_merges += 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: none, with the columns appended, if no shard has a row.

        A store without a version cannot be read.
        """
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:  # arrivals without rows leave a file that holds their columns and no version lists
            return self.spark.read.parquet(f"{self.root}/shards/*").where("false")
        return self.spark.read.parquet(*paths)

    def vacuum(self, keep: int = KEEP) -> int:
        """Delete versions before the newest ``keep``, and shards that only they list; how many. Readers of a kept version go on."""
        versions = self.versions()
        live, old = versions[-keep:], versions[:-keep]
        if not old:
            return 0
        paths = lambda some: reduce(DataFrame.unionByName, [self.manifest(v).select("path") for v in some]).distinct()
        gone = [r["path"] for r in paths(old).join(paths(live), "path", "left_anti").collect()]
        for path in gone:
            self._fs.delete(self._path(path), False)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifests/v={v}"), True)
        return len(gone)


def shard(store: ShardStore, arrivals: list[DataFrame]) -> DataFrame:
    """Append each arrival, compact after each, vacuum all but the last KEEP versions; the rows of the final version.

    Every row of every arrival is in the result once, with all its columns as they were, whatever
    their names: nulls, repeated rows, empty and very long texts too. Arrivals without rows add
    nothing; if none has any, the result is empty. Columns must agree between arrivals.
    """
    for df in arrivals:
        store.append(df)
        if store.compact():
            store.vacuum()
    return store.read()
