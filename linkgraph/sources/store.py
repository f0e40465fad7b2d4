"""Stage tables in the shared checkpoint folder.

A stage that several later plans read (edges, banded edges, candidates) is
written once as parquet under `spark.checkpoint.dir` and read back.  That
cuts the lineage (a lost executor re-reads files instead of recomputing the
join/aggregate chain), gives the planner real size statistics, and stops
Catalyst from inlining the same aggregate into many branches of a plan.

Stage tables belong to the application: they are deleted when it ends, or
earlier by `drop_stage`, which takes the DataFrame that `materialize` or
`materialize_bucketed` gave.
"""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from linkgraph.session import ensure_checkpoint_dir

_stages: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def stage_path(df: DataFrame, name: str) -> str:
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    return f"{base}/linkgraph-stages/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """The shuffle files of a write made in the block go when it has finished, on all
    executors; nothing reads them again, as later plans read the written table."""
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "true")
    try:
        yield
    finally:
        spark.conf.set(conf, was)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to a fresh stage folder and return a scan of it."""
    path = stage_path(df, name)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    _stages[path] = df.sparkSession
    with shuffles_freed(df.sparkSession):
        w.parquet(path)
    reader = df.sparkSession.read if partition_by else df.sparkSession.read.schema(df.schema)
    out = reader.parquet(path)
    out._stage_path = path
    return out


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """Write `df` to the folder `path`, bucketed and sorted by `keys`, and return a
    scan that knows it: joins and groups by all of `keys` need no exchange of tables
    with equally many buckets (the number of shuffle partitions unless given).

    One shuffle by the bucket hash comes first, so a bucket is one file.  The catalog
    entry that carries the layout is dropped when the application ends; the files stay."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"linkgraph_{uuid.uuid4().hex}"
    _tables[table] = spark
    dealt = df.repartition(n, *keys).write.format("parquet").mode("overwrite")
    with shuffles_freed(spark):
        dealt.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._stage_table = table
    return out


def without_files(spark: SparkSession, path: str) -> bool:
    """Did a write leave no data in the folder `path`?  By partitions or buckets, Spark
    makes no file of a table without rows, and a folder without files has no schema."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return all(f.getPath().getName().startswith(("_", ".")) for f in found)


def write_columns(df: DataFrame, path: str) -> None:
    """The columns of `df`, which has no rows, as one plain file: it can be read by its path."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def materialize_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """`materialize` as a bucketed stage table."""
    path = stage_path(df, name)
    _stages[path] = df.sparkSession
    out = write_bucketed(df, path, keys, buckets)
    out._stage_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path beside the stage tables, deleted with them."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/linkgraph-stages/{name}-{uuid.uuid4().hex}"
    _stages[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stage(df: DataFrame) -> None:
    """Delete a stage table that no later plan reads."""
    table, path = getattr(df, "_stage_table", None), getattr(df, "_stage_path", None)
    if table and _tables.pop(table, None) is not None:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path and _stages.pop(path, None) is not None:
        _delete(df.sparkSession, path)


@contextmanager
def stages_freed(*, but: list[DataFrame]):
    """Delete the stage tables made inside the block when it ends, but those of the
    DataFrames that the block put on the list `but`; what the block returns may read
    only these.  If the block fails, nothing is deleted early."""
    paths, tables = set(_stages), set(_tables)
    yield
    spared = {getattr(df, a, None) for df in but for a in ("_stage_path", "_stage_table")}
    for table in set(_tables) - tables - spared:
        _tables.pop(table).sql(f"DROP TABLE IF EXISTS {table}")
    for path in set(_stages) - paths - spared:
        _delete(_stages.pop(path), path)


@atexit.register
def drop_all_stages() -> None:
    """Delete what is left when the application ends."""
    def alive(spark: SparkSession) -> bool:
        return spark._jsc is not None and not spark._jsc.sc().isStopped()
    try:
        for table, spark in list(_tables.items()):
            _tables.pop(table)
            if alive(spark):
                spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path, spark in list(_stages.items()):
            _stages.pop(path)
            if alive(spark):
                _delete(spark, path)
    except Exception:  # the JVM may be gone already at interpreter exit
        return
