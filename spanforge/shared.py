"""Tables written into the folder that every machine of the cluster can read.

Long jobs cut their lineage by writing a table and reading it again, so a lost
executor costs the tasks it ran and never the work before the table. The
folder is the session's ``spark.checkpoint.dir``; only where that is unset and
the master is local, as in tests, a temporary folder is made for the session.
On a cluster a session without it is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Tables of this session that were not removed yet, and those written within ``temporary``.
_made: set[str] = set()
_within: list[set[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made and set where there is none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines reach")
        if not _own:
            made = tempfile.TemporaryDirectory(prefix="spanforge-")
            atexit.register(made.cleanup)
            _own.append(made.name)
        d = _own[0]
    return d


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A place for a table; ``keep`` it beyond the innermost ``temporary``."""
    path = f"{shared_dir(spark).rstrip('/')}/spanforge/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    for made in _within[: -1 if keep else None]:
        made.add(path)
    return path


@contextlib.contextmanager
def written() -> Iterator[set[str]]:
    """The places of the tables that are written within."""
    _within.append(set())
    try:
        yield _within[-1]
    finally:
        _within.pop()


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written within; what reads them must have run by then."""
    with written() as made:
        yield
    for path in made & _made:
        remove(spark, path)


def write_table(df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet into the shared folder; returns the table read again and its path."""
    spark = df.sparkSession
    path = new_path(spark, name, keep)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets the driver notice which shuffles nothing refers to any more; Spark then deletes their files everywhere.

    A job's last event still refers to its plan until all listeners have seen it, so the driver looks twice.
    """
    for pause in (0.5, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that is no longer read."""
    _made.discard(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session wrote; what reads them can't run any more."""
    for path in list(_made):
        remove(spark, path)
