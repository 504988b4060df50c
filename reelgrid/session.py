"""Session helpers: table access, the shared folder and written intermediates.

The shared folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of our own is set only where that
setting is missing (local tests). Nothing here uses localCheckpoint or a machine-local folder on a cluster.
"""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give this package's code to the executors' Python, once per context, as an archive in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_reelgrid_shipped", False):
        return
    home, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, source.relative_to(home.parent))
    where = sc._jvm.org.apache.hadoop.fs.Path(f"{_own_dir(spark)}/reelgrid-code-{uuid.uuid4().hex}.zip")
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(where.toString())
    sc._reelgrid_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='reelgrid-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/reelgrid/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove everything that this application has written in the shared folder."""
    dropped(spark, _own_dir(spark))


def written(df: DataFrame, label: str, **options: str) -> str:
    """Write ``df`` as parquet below the shared folder and return its path.

    A written table survives the loss of executors and cuts the lineage. ``clean`` removes all tables of the
    application, ``dropped`` a single one.
    """
    path = f"{_own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` read back from a table written in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))


def kept(df: DataFrame, label: str, build: Callable[[str], None]) -> str:
    """The path of a table that ``build(path)`` writes from ``df``, kept in the shared folder for later applications.

    It is found again by ``label`` (which has to name what is built) and by the names, sizes and times of the files
    that ``df`` reads; a change of any of them builds it anew. A frame without files is written for this application only.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for name in sorted(df.inputFiles()):
        where = jvm.org.apache.hadoop.fs.Path(name)
        told = where.getFileSystem(conf).getFileStatus(where)
        seen.append(f"{name} {told.getLen()} {told.getModificationTime()}")
    if not seen:
        path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
        build(path)
        return path
    path = f"{shared_dir(spark)}/reelgrid/kept/{label}-{hashlib.md5(chr(10).join(seen).encode()).hexdigest()}"
    done = jvm.org.apache.hadoop.fs.Path(path)
    files = done.getFileSystem(conf)
    if not files.exists(done):
        began = f"{path}-{uuid.uuid4().hex}"
        build(began)
        if not files.rename(jvm.org.apache.hadoop.fs.Path(began), done):  # another application was first
            dropped(spark, began)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table made by ``written``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(spark: SparkSession, path: str) -> list[str]:
    """The data files of a written table and its subfolders, as URIs; one entry per file, no rows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        name = str(found.next().getPath().toString())
        if name.endswith(".parquet"):
            out.append(name)
    return sorted(out)
