"""Session helpers of the corpus operators: tables, shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import release

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="foliospark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage is cut and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session has ended: its folder goes with the cluster
            return


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of df is called that (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: a table of at most so many bytes, as written, is sent to all executors
BROADCAST_BYTES = 32 << 20
#: bytes of a table's files that one hash range takes
FRAGMENT_BYTES = 64 << 20


def fragments(spark: SparkSession, df: DataFrame | None = None, least: int = 8) -> int:
    """Number of hash ranges: spark.sql.shuffle.partitions, or more if df's files are larger than that many ranges
    of ``FRAGMENT_BYTES`` (by the optimizer's statistics of the tables that it reads)."""
    count = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df is None:
        return count
    bytes_read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(count, -(-bytes_read // FRAGMENT_BYTES)), 1 << 20) if bytes_read < 1 << 60 else count  # no statistics


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files are under ``BROADCAST_BYTES``; else Catalyst chooses."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for file in df.inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(file)
        total += at.getFileSystem(conf).getFileStatus(at).getLen()
        if total > BROADCAST_BYTES:
            return df
    return F.broadcast(df)


def present(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def released(result: pa.Table) -> pa.Table:
    """The result of a group's function, after the allocators gave back what the function freed."""
    release()
    return result
