"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    named = context._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-checkpoints-")
    context.setCheckpointDir(folder)
    return folder


#: Files of a narrow table for each core.
FILES_PER_CORE = 4


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """``df`` computed once and kept in the shared folder.

    ``narrow``: rows are a few numbers, so that a few files for each core are enough for any number of them; a table
    that is kept again and again would else leave a small file for each shuffle partition each time.
    """
    shared_folder(df.sparkSession)
    if narrow:
        df = df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
