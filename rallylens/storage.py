"""Where shared intermediate data goes.

A cluster names one shared folder in ``spark.checkpoint.dir``.  Everything that
cuts lineage or lands a table between two jobs uses that folder, so the loss of
an executor never loses data.  Only a session on one machine (``local[...]``)
without the setting gets a folder of its own; other sessions must name one.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_cleaned: set[str] = set()
# Tables of every open ``passing_tables``: the folder of each table landed since.
_passing: list[dict[str, DataFrame]] = []
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """This application's part of the shared folder.

    ``spark.checkpoint.dir`` comes first, then a folder given to
    ``setCheckpointDir``.  The tables below it are removed when Python ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = "file:" + context._jvm.System.getProperty("java.io.tmpdir") + "/rallylens"
    root = f"{named.rstrip('/')}/tables-{context.applicationId}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be stopped already
        return


class PassingTables:
    """Tables landed since it was opened."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}

    def keep_only(self, *kept: DataFrame) -> None:
        """Remove all of them but ``kept`` from the shared folder; nothing may read them any more."""
        for path, table in list(self.tables.items()):
            if not any(table is k for k in kept):
                _remove(self.spark, path)
                del self.tables[path]


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[PassingTables]:
    """For long chains of steps: no more stays on disk than the next step reads.

    Shuffles of a finished query are removed at once, not when the driver
    happens to collect its garbage; tables landed inside can be let go.
    """
    passing, before = PassingTables(spark), spark.conf.get(FREE_SHUFFLES, None)
    _passing.append(passing.tables)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield passing
    finally:
        _passing.remove(passing.tables)
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage like a checkpoint, but columnar, compressed and with sizes
    the planner can use.  A lost executor costs nothing that is landed.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    back = df.sparkSession.read.schema(_nullable(df.schema)).parquet(path)
    for tables in _passing:
        tables[path] = back
    return back


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Compute ``df`` once and cut its lineage; for tables read several times.

    ``compression`` (``zstd`` for long texts) takes the place of the session's.
    Vectors and other types without a Parquet form go through a reliable
    checkpoint, everything else through a landed table.
    """
    spark = df.sparkSession
    if any(isinstance(f.dataType, T.UserDefinedType) for f in df.schema.fields):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_root(spark))
        return df.checkpoint(eager=True)
    return landed(df, "settled", compression)


def table_size(table: DataFrame) -> int:
    """Bytes of the files of a settled table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few splits over all cores, before costly text rules.

    For plain scans, settled tables and projections of them: asking a plan
    with shuffles for its partitions would run it.  A large input has more
    splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
