"""Cutting lineage in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Whether Spark deletes a plan's shuffle files when its action ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The folder is ``spark.checkpoint.dir``. Where that is unset, a local
    session (one machine, as in tests) gets a temporary folder; a session on a
    cluster is refused, since executors there share no folder that could be
    made up here. Shuffle files of the plan that was cut are deleted at once, since nothing reads
    them again.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="darkspace-checkpoint-")
        context.setCheckpointDir(folder)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # holds for plans that are made while it is set
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)
