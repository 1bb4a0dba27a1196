"""Sessions and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: dict[str, str] = {}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as used by tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where a session on one machine names none (tests) a folder of its own is made for
    the driver's lifetime; on a cluster executors would not share it, so that raises.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="termloom-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in this application's part of the shared folder, which goes when the application ends."""
    context = spark.sparkContext
    root = getattr(context, "_termloom_scratch", None)
    if root is None:
        root = context._termloom_scratch = f"{shared_folder(spark)}/termloom/run-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it back.

    The schema is given to the reader, so empty results come back whole and no
    file has to be opened for it.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    # columns that name folders come last when they are read
    plain = [f for f in df.schema if f.name not in partition_by]
    return spark.read.schema(T.StructType([*plain, *(df.schema[c] for c in partition_by)])).parquet(path).select(*df.columns)


#: Bytes of a batch that a Python worker is sent at once; rows of any length are then held in bounded memory.
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever their path: once a context, as --py-files does.

    Batches sent to them are bounded by bytes, not by rows alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    context = spark.sparkContext
    if getattr(context, "_termloom_shipped", None) is None:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="termloom-code-")
        atexit.register(shutil.rmtree, folder, True)
        target = f"{folder}/termloom_code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(target)
        context._termloom_shipped = target
    return spark
