"""Session, table access and written intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "msgsieve", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if (master or "").startswith("local"):
        # On a single machine; a cluster keeps its own number, and large steps state theirs by the rows.
        settings["spark.sql.shuffle.partitions"] = "8"
    settings |= conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that workers find it wherever it was imported from."""
    sc = spark.sparkContext
    if getattr(sc, "_msgsieve_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="msgsieve-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "msgsieve.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"msgsieve/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._msgsieve_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; every query reads through here."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, rows: int, per: int) -> int:
    """Shuffle partitions so that each gets about ``per`` of ``rows``, never fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))


def spread(df: DataFrame, per_core: int = 16 << 20) -> DataFrame:
    """A small input over all cores, for work that costs more than moving it.

    A file of few row groups keeps few cores busy. Only inputs of less than ``per_core`` bytes a core by the
    planner's own estimate are moved; larger ones have enough parts and stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if size < per_core * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else a local one.

    Only a local master may leave the folder unset (tests, a single machine);
    on a cluster a machine-local folder would lose tables with its machine, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    d = os.path.join(tempfile.gettempdir(), "msgsieve-shared")
    os.makedirs(d, exist_ok=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{d}")
    return f"file://{d}"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    if not path_exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def remove_path(spark: SparkSession, path: str) -> None:
    _drop(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back.

    The table survives the loss of executors. It is removed by ``release``, at the
    latest when the driver ends. Parquet keeps column pruning for the readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/msgsieve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Removes written tables that no later plan reads, and with them the shuffles of plans that are gone; other DataFrames are left alone."""
    spark = None
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            _drop(spark, path)
    if spark is not None:
        # Spark deletes a shuffle once the driver's collector has found its plan unused, by itself every half hour.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
