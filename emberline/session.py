"""Session helpers: the settings the engine relies on and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that results, or the streams' exact state at scale, depend on.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects may repeat a key; the last one counts, as in JSON.parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Keyed state with more than one variable needs this store.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A micro-batch uploads what it changed of the state, not the whole store.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session created elsewhere."""
    for name, value in REQUIRED_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``.

    Where a single-machine session (master ``local``) names none, a temporary folder stands in and
    becomes the checkpoint folder. On a cluster every executor would write to its own disk, so a
    missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.conf.get("spark.master", "").partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store an intermediate result in the shared folder and continue from the stored copy."""
    spark = df.sparkSession
    path = shared_folder(spark, "step")
    if (steps := _passing.get()) is not None:
        steps.append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """What ``cut_lineage`` stores inside is deleted at the end: for work whose results are written by then."""
    before = _passing.set(steps := [])
    try:
        yield
    finally:
        _passing.reset(before)
        for step in steps:
            path = spark._jvm.org.apache.hadoop.fs.Path(step)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
