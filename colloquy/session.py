"""Session helpers: shared scratch storage and table access."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_colloquy_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory() as tmp:
            archive = shutil.make_archive(f"{tmp}/colloquy", "zip", root.parent, root.name)
            kept = shutil.copy(archive, Path(tempfile.mkdtemp(prefix="colloquy-code-")) / "colloquy_code.zip")
        sc.addPyFile(str(kept))
        sc._colloquy_shipped = sc.applicationId
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read lazily through Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    It is read from ``spark.checkpoint.dir``; only when that is unset and all of Spark runs in one
    process (tests) is a local folder made up and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="colloquy-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; ``clear`` deletes all that were given out."""
    path, sc = f"{scratch_root(spark)}/colloquy-{name}-{uuid.uuid4().hex}", spark.sparkContext
    sc._colloquy_scratch = [*getattr(sc, "_colloquy_scratch", []), path]
    return path


def clear(spark: SparkSession) -> int:
    """Delete every folder that this application was given, for its owner to call when no answer is read any more; how many were there."""
    sc, gone = spark.sparkContext, 0
    for path in getattr(sc, "_colloquy_scratch", []):
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True))
    sc._colloquy_scratch = []
    return gone


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder and read it back.

    With ``folders`` the rows lie in one folder for each value of these columns, which filters on them prune.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    spark = df.sparkSession
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    # folders of a partitioned table lie below the table's own
    folders = {re.sub(r"(/colloquy-[^/]+)/.*$", r"\1", f) for f in df.inputFiles()}
    for folder in folders:
        if "/colloquy-" in folder and root.split(":", 1)[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
