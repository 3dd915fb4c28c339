"""Session construction and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("contactmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="contactmill-checkpoint-"))
        .config("spark.driver.memory", os.environ.get("CONTACTMILL_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; choose one only where none is set, on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    one_machine = sc.master == "local" or sc.master.startswith("local[")
    if not named and not one_machine:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="contactmill-checkpoint-"))


class RoundTables:
    """Paths of the tables that the rounds of a loop have written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rounds = spark, [[]]

    def turn(self) -> None:
        """A round is over: what was written in the round before it goes, for the loop works on the last round only."""
        self.rounds.append([])
        for path in self.rounds.pop(0) if len(self.rounds) > 2 else ():
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)


_OWNER: ContextVar[RoundTables | None] = ContextVar("_OWNER", default=None)


@contextmanager
def round_tables(spark: SparkSession) -> Iterator[RoundTables]:
    """Inside, `materialize` hands its tables to the loop, which deletes them two turns later."""
    owner = RoundTables(spark)
    token = _OWNER.set(owner)
    try:
        yield owner
    finally:
        _OWNER.reset(token)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back.

    Later reads survive lost executors, never recompute, and plan from the table's real size. Unlike checkpoint(), the
    result carries no constraints of the plan behind it; those grow with every step of an iteration.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (owner := _OWNER.get()) is not None:
        owner.rounds[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_layout(df: DataFrame) -> DataFrame:
    """Checkpoint df keeping its partitioning, for a large table that many later joins read by the same keys."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
