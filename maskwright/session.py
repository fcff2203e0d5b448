"""What a session needs before it runs this library's Python code, and the tables that runs leave in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _own_folder() -> str:
    """A temporary folder of this process, deleted when it ends."""
    folder = tempfile.mkdtemp(prefix="maskwright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, unless it came as an archive already."""
    context, here = spark.sparkContext, Path(__file__).resolve().parent
    if here.is_dir() and not getattr(context, "_maskwright_shipped", False):
        archive = f"{_own_folder()}/maskwright.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(here.rglob("*.py")):
                z.write(source, Path(here.name) / source.relative_to(here))
        context.addPyFile(archive)
        context._maskwright_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where the session names none, one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{_own_folder()}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _run_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one."""
    return f"{shared_folder(spark)}/maskwright/{spark.sparkContext.applicationId}"


def run_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's folder; what is written there goes with clear_stashes()."""
    if not getattr(spark.sparkContext, "_maskwright_clears", False):
        atexit.register(clear_stashes, spark)
        spark.sparkContext._maskwright_clears = True
    return f"{_run_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, so a
    lost executor costs a re-read, and later steps all see the very same rows and row order.

    Operators discard() the tables that their result no longer reads.  Those that a lazy result still reads stay until
    clear_stashes(), which also runs when the driver's Python ends with its session still up."""
    spark = df.sparkSession
    path = run_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(*stashed: DataFrame | None) -> None:
    """Deletes the files of stashed tables that nothing reads any more."""
    for df in (d for d in stashed if d is not None):
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/maskwright/" in f}:
            _delete(df.sparkSession, folder)


def clear_stashes(spark: SparkSession) -> None:
    """Deletes all tables that this application has stashed; results that were not written out by then can't be read any more."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, _run_folder(spark))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def width_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for so many rows: the session's width, or more where that would put more than rows_each into one."""
    return max(shuffle_width(spark), -(-rows // rows_each))


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores in front until no column of taken is called so, in whichever case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name
