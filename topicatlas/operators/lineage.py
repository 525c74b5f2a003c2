"""Where written intermediate tables go, and how long lineages are cut."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Frees the shuffle files of a finished write; the written table takes their place.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; on ``local`` masters a new one in its absence.

    A cluster that names none is an error: the other machines would not see a
    machine-local folder, and a table that is only kept in memory is lost with its
    executors.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="topicatlas-"))
        folder = context.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a written table.

    Losing an executor then costs a re-read, not a recomputation from the raw
    files, and the optimizer knows the true size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file, in whatever store the path names."""
    context = spark.sparkContext
    file = context._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(context._jsc.hadoopConfiguration()).exists(file)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
