"""What the operators of this subpackage share: column picking, the shared work folder, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweir.shipping import ship

#: The ASCII white space that separates words in every contract of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, found by exact name, whatever other columns `df` has (in any case)."""
    places = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(places, names, strict=True)])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as `__`) that hold inside the block only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    `spark.checkpoint.dir` is read from the session. Where it is unset, a temporary folder is made and set as
    the checkpoint folder, but only if the driver and the executors are one machine (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='factweir-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/factweir/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, survives lost executors, computed once.

    The write's shuffle files go when it is done; a reader of `df` itself would compute them again.
    """
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes work tables that nothing reads any more."""
    for f in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Readies a session for Python tasks over whole texts.

    Executors get this package, unless they have it. Arrow batches hold at most `rows` rows and about 32 MB,
    which bounds a Python worker's memory when texts are long; smaller bounds of the session stay.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 32 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int("".join(c for c in spark.conf.get(name) if c.isdigit()))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    ship(spark)
