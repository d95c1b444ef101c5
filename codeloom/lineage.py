"""Lineage cuts, for loops whose steps build on one another, and steps that do not."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructType


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: that of the session's ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder exists, a session on this machine alone gets a temporary
    one; on a cluster, whose executors would not share it, this is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the shared checkpoint folder as a table and read from there.

    A written table has a known size, so the planner can tell which side of a join is small, and small files are
    read together. Columns without a type hold nothing but nulls and are not written. Tables stay as long as the
    folder does: whatever is computed from one can be computed again after an executor is lost. They are packed
    more closely than Spark's own files, as they are read a few times only.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    typed = [f for f in df.schema if not isinstance(f.dataType, NullType)]
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    df.select(*[named(f.name) for f in typed]).write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(StructType(typed)).parquet(path)
    return rows if len(typed) == len(df.columns) else rows.select(*[named(f.name) if f in typed else F.lit(None).alias(f.name) for f in df.schema])


def together(spark: SparkSession, *steps: Callable[[], object]) -> list:
    """What steps that need nothing of one another return. Their jobs run at the same time, so a job with a few small tasks does not keep the others waiting."""
    if len(steps) < 2:
        return [step() for step in steps]
    with ThreadPoolExecutor(len(steps)) as pool:
        begun = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [x.result() for x in begun]
