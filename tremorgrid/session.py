"""Session construction and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tremorgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on: UTC time, AQE and skew joins."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark`` (once per application)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tremorgrid-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the cluster names it in ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode with the setting absent. On a cluster an
    executor-local folder would lose data with the executor, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tremorgrid-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy survives lost executors, is the same on every later scan, prunes columns, and gives
    the planner a true size, so small tables are broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/table-{uuid.uuid4().hex}"
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared folder: intermediate tables and scratch folders."""
    return f"{shared_dir(spark)}/tremorgrid-{spark.sparkContext.applicationId}"


#: Intermediate tables that have been written and not been deleted, by application.
_TABLES: dict[str, list[str]] = {}


def tables(spark: SparkSession) -> list[str]:
    """Paths of the intermediate tables that ``cut`` has written and nothing has deleted, in order."""
    return list(_TABLES.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete these intermediate tables; only for a caller who knows that nothing will read them again."""
    known = _TABLES.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in known:
            _delete(spark, path)
            known.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables and scratch folders of this application; results read from them are then gone."""
    _delete(spark, own_dir(spark))
    _TABLES.pop(spark.sparkContext.applicationId, None)
