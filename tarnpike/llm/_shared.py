"""Session helpers of the text operators: shared working tables and table reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tarnpike.functions.session import ready as _findable

#: rows of texts that a Python worker gets at once, unless the session says otherwise
BATCH_ROWS = 2_000
_WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """Workers find this package, take texts in small batches and give memory back that they no longer use."""
    _findable(spark)
    for name, value in _WORKER.items():
        spark.sparkContext.environment.setdefault(name, value)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) >= 10_000:  # Spark's default; texts are longer than rows of numbers
        spark.conf.set(rows, BATCH_ROWS)
    return spark


_own: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share, by spark.checkpoint.dir or the context's checkpoint directory. Where neither is set, a temporary folder of this
    process if executors are in it (master local), else an error: other machines would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_.get() if set_.isDefined() else None
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tarnpike-"))
    return _own[0]


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def own_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet, deleted when the driver ends."""
    path = f"{work_dir(spark)}/tarnpike-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes with ``released``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tarnpike-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    at, fs = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(schema).parquet(path)
    out._tarnpike_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for t in tables:
        at, fs = _file_system(t.sparkSession, t._tarnpike_path)
        fs.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
