"""Sinks, memoised stages and contracts. Paths are Spark's: any store that it can open."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The local folder of each application without a shared one.
_local: dict[str, str] = {}


def new_path(spark: SparkSession) -> str:
    """A path in the folder that driver and executors share. Where none is set, a local one for a local master, and an error for any other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="dyadlake-")
        _local[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/dyadlake-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage was completely written there: Spark leaves a success marker when all its tasks have ended."""
    at, system = _at(spark, f"{path.rstrip('/')}/_SUCCESS")
    return system.exists(at)


def stage(df: DataFrame, path: str | None = None, rebuild: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet (zstd) and re-read; a later call with the same path reads what is there, if it was written to the end."""
    spark = df.sparkSession
    path = path or new_path(spark)
    if rebuild or not exists(spark, path):
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.parquet(path)
    same_columns(out, df)
    return out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind: Spark deletes those of a job when it has ended, not when the driver's garbage is next collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def version(spark: SparkSession, paths: list[str]) -> str:
    """What the files of some inputs are, now: a digest of their names, lengths and times of change. No file is opened."""
    seen = []
    for path in paths:
        at, system = _at(spark, path)
        found = system.listFiles(at, True)
        while found.hasNext():
            f = found.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def addressed(df: DataFrame, root: str, build: str = "") -> DataFrame:
    """``df`` as a stage that is found by its content: the folder's name follows from the plan (``semanticHash`` and columns), the files that it reads, as they are now, and ``build``. Changed inputs, another plan or another build make a new stage; otherwise what is there is read.

    A writer works in a folder of its own, which gets the stage's name by a rename only when it is complete: half-written stages are never read, a lost writer leaves nothing under the name, and of two writers at once the first to finish wins and the other reads what that one wrote."""
    spark = df.sparkSession
    inputs = sorted(df.inputFiles())
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    plan = str(df.semanticHash() & 0xFFFFFFFF)
    key = hashlib.sha256("\n".join([plan, columns, version(spark, inputs), build]).encode()).hexdigest()[:40]
    path = f"{root.rstrip('/')}/stage-{key}"
    if not exists(spark, path):
        own = f"{root.rstrip('/')}/writing-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(own)
        publish(spark, own, path)
    out = spark.read.parquet(path)
    same_columns(out, df)
    return out


def publish(spark: SparkSession, own: str, path: str) -> bool:
    """Renames a complete folder to ``path``. False, and the folder is deleted, if a complete one is there already; what is there without a success marker is replaced."""
    (here, system), (there, _) = _at(spark, own), _at(spark, path)
    if not exists(spark, own):
        raise ValueError(f"{own} was not written to the end")
    if system.exists(there) and not exists(spark, path):
        system.delete(there, True)
    if not system.exists(there) and system.rename(here, there):
        inside, _ = _at(spark, f"{path}/{own.rstrip('/').rsplit('/', 1)[1]}")  # another was faster, so the rename went into its folder
        if not system.exists(inside):
            return True
        system.delete(inside, True)
        return False
    system.delete(here, True)
    return False


def once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage that all queries of an application over the same tables share: made by the first, read by the others, made anew when one of the tables' files has changed. Two that start together write two folders, of which one is kept."""
    key = hashlib.md5(f"{name} {sf_dir} {version(spark, [sf_dir])}".encode()).hexdigest()
    root = new_path(spark).rsplit("/", 1)[0]
    path = f"{root}/dyadlake-{spark.sparkContext.applicationId}-{key}"
    if not exists(spark, path):
        own = f"{root}/writing-{uuid.uuid4().hex}"
        make().write.option("compression", "zstd").parquet(own)
        publish(spark, own, path)
    return spark.read.parquet(path)


def csv_roundtrip(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as CSV with a header and re-read with its schema."""
    path = path or new_path(df.sparkSession)
    df.write.mode("overwrite").csv(path, header=True)
    return df.sparkSession.read.csv(path, header=True, schema=df.schema)


def same_columns(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both have the same columns and types, in any order."""
    kinds = lambda df: {f.name: f.dataType.simpleString() for f in df.schema}
    if kinds(a) != kinds(b):
        raise ValueError(f"columns differ: {set(kinds(a).items()) ^ set(kinds(b).items())}")


def unique_key(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that stand more than once: empty if the contract holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def json_roundtrip(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as JSON lines and re-read with its schema."""
    path = path or new_path(df.sparkSession)
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.json(path, schema=df.schema)


def discover(spark: SparkSession, candidates: list[str], required: list[str]) -> str:
    """The first folder, in any store, that holds all required files; FileNotFoundError if none does."""
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(settings).exists(at)

    for folder in candidates:
        if all(there(f"{folder.rstrip('/')}/{name}") for name in required):
            return folder
    raise FileNotFoundError(f"none of {candidates} holds {required}")
