"""Tables written in the folder that driver and executors share, to cut the lineage of iterations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: A table of so many rows at most is broadcast; rows of groups and models are some hundred bytes.
FEW_ROWS = 100_000
#: A key that more rows share is joined apart.
HOT_ROWS = 1000
#: Rows that a task of an iteration is given, and pairs that a task makes.
TASK_ROWS, TASK_PAIRS = 250_000, 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given where that is unset.

    With neither, a session in a single process (tests) gets a temporary folder; on a cluster there is
    none that executors are known to share, which is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        top = context.getCheckpointDir()
    return top.rstrip("/")


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``df`` written as Parquet in the shared folder and read back, and ``metrics`` (aggregates) of what was written.

    Lineage ends there: a lost executor costs a read, not the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    seen = Observation() if metrics else None
    rows = df.observe(seen, *[m.alias(k) for k, m in metrics.items()]) if metrics else df
    rows.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get if metrics else {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back."""
    return observed(df, name)[0]


def small(df: DataFrame, name: str, most: int = FEW_ROWS) -> DataFrame:
    """``df`` written, and marked for broadcast if it has ``most`` rows or fewer; else it is joined like any table."""
    table, seen = observed(df, name, n=F.count(F.lit(1)))
    return F.broadcast(table) if seen["n"] <= most else table


def hot_keys(rows: DataFrame, key: str, most: int = HOT_ROWS) -> DataFrame | None:
    """The values of ``key`` that more than ``most`` rows share, or None; there are count / most at most."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key)
    table, seen = observed(counts, "hot-keys", n=F.count(F.lit(1)))
    return (F.broadcast(table) if seen["n"] <= FEW_ROWS else table) if seen["n"] else None


def join_spread(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once; rows of ``hot`` keys stay where they are and meet a broadcast."""
    if hot is None:
        return rows.join(table, key)
    few = small(table.join(hot, key, "left_semi"), "hot-rows")
    warm = rows.join(hot, key, "left_semi").join(few, key)
    return rows.join(hot, key, "left_anti").join(table, key).unionByName(warm)


def dealt(rows: DataFrame, key: str, n_tasks: int) -> DataFrame:
    """``rows`` dealt by ``key`` to so many tasks and kept by the executors, so that joins by it don't move them again; unpersist() ends that.

    What is lost is read and dealt again. Rows should be a written table.
    """
    return rows.repartition(n_tasks, key).persist(StorageLevel.MEMORY_AND_DISK)


def tasks_for(n_rows: int) -> int:
    """How many tasks share so many rows, TASK_ROWS each."""
    return max(1, -(-n_rows // TASK_ROWS))


def join_groups(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``few`` by a key that very many of both share. No pair is shuffled or written.

    Rows are spread whatever their key, so that a task makes TASK_PAIRS or so; ``few`` is broadcast, FEW_ROWS of it at once.
    """
    rows = written(rows, "group-rows")
    few, seen = observed(few, "group-few", n=F.count(F.lit(1)))
    sizes = [t.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(n)) for t, n in ((rows, "n"), (few, "m"))]
    n_pairs = sizes[0].join(sizes[1], key).agg(F.sum(F.col("n") * F.col("m")).alias("n")).first()["n"] or 0
    spread, groups, out = rows.repartition(int(n_pairs // TASK_PAIRS) + 1), max(1, -(-seen["n"] // FEW_ROWS)), None
    for group in range(groups):
        part = spread.join(F.broadcast(few.where(F.pmod(F.xxhash64(*few.columns), F.lit(groups)) == group)), key)
        out = part if out is None else out.unionByName(part)
    return out


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files under a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def discard(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            remove_folder(table.sparkSession, folder)
