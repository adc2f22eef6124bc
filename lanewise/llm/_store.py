"""Shared storage for intermediate tables and names for temporary columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (of 50 bytes a row at most) is broadcast after a count.
MOST_BROADCAST = 500_000


def _one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one in ``spark.checkpoint.dir``.

    Where that is unset a new local folder serves, if driver and executors are one process; on a cluster it is an error.
    """
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not _one_process(context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lanewise-"))
        kept = context._jsc.sc().getCheckpointDir()
    return kept.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with columns of any type, computed once and kept in the shared checkpoint folder; survives the loss of executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def pinned(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder; survives the loss of executors.

    A table's size is known to the optimiser, while a checkpoint carries the estimate of its plan on, which grows with each join
    until estimates alone take minutes.
    """
    return written(df, "pinned")


def near(df: DataFrame) -> DataFrame:
    """A narrow table pinned and counted: to be broadcast if it is small.

    Beyond MOST_BROADCAST rows it is joined by a shuffle. As it is a table, both sides of such a join are plain exchanges, whose hot
    partitions Spark can split.
    """
    kept = pinned(df)
    return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more, between steps of a long job.

    Their checkpoint files go too if ``spark.cleaner.referenceTracking.cleanCheckpoints`` was set when the context began; else they
    stay until the checkpoint folder is cleared.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a columnar table in the shared checkpoint folder, read back. ``removed`` deletes it."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``written`` or ``pinned`` made, once nothing reads them any more; other files stay."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        folder = path(checkpoint_folder(table.sparkSession)).toUri().getPath()
        for parent in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if path(parent).toUri().getPath().startswith(folder + "/"):
                path(parent).getFileSystem(context._jsc.hadoopConfiguration()).delete(path(parent), True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{stem}{n}"
    return name


def shipped(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once for each context, so that Python tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_lanewise_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="lanewise-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._lanewise_shipped = True
