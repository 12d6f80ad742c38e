"""Session settings, shared-folder tables and small helpers that every operator uses."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_owned: set[tuple[int, str]] = set()
_sessions: dict[int, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (local tests) a folder of this machine is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = spark.sparkContext.getCheckpointDir()
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _owned.add((id(spark), path))
    _sessions[id(spark)] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lf_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialize`; nothing else is touched."""
    path = getattr(df, "_lf_path", None)
    if path:
        _delete(df.sparkSession, path)
        _owned.discard((id(df.sparkSession), path))


def clear(spark: SparkSession) -> int:
    """Delete all tables that :func:`materialize` wrote in this session, and say how many. For long sessions, between
    results: DataFrames planned on them can't be computed any more. At exit this happens by itself."""
    mine = [(k, path) for k, path in _owned if k == id(spark)]
    for key, path in mine:
        _delete(spark, path)
        _owned.discard((key, path))
    return len(mine)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for key, path in list(_owned):
        try:
            _delete(_sessions[key], path)
        except Exception:  # the JVM may be gone already
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_lf_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lumenframe-")) / "lumenframe.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"lumenframe/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._lf_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "lumenframe", cpus: int | None = None) -> SparkSession:
    """Session for tests and benches on one machine."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
