"""Session settings, the shared scratch folder, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows a lookup may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 10_000

_local_dirs: dict[str, str] = {}


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "threadloom") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a fresh
    temporary folder for the life of the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="threadloom-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/threadloom/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors and keeps column
    pruning and filter pushdown for every later read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing will read any more; loops call it for the rounds behind them."""
    for table in tables:
        session = table.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside; afterwards it is as before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further."""
    return df.limit(max_rows + 1).count() <= max_rows


def pinned(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` computed once, and whether it has at most ``max_rows`` rows.

    A small table is kept as literal rows, at most ``max_rows + 1`` of which
    reach the driver; a bigger one is settled.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return settle(df, "lookup"), False


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast lookup if it is small; a bigger one joins by shuffle."""
    table, small = pinned(df, max_rows)
    return F.broadcast(table) if small else table


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Rows dealt over ``partitions`` tasks if the caller asks for it.

    A few unsplittable files (compressed dumps, one big row group) leave most
    cores idle during heavy text work; dealing them costs a shuffle of the rows.
    """
    return df.repartition(partitions) if partitions else df
