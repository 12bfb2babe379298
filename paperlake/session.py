"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the operators rely on. All are ordinary Spark settings a cluster may override.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "paperlake", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster such a folder
    would vanish with its machine, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="paperlake-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    This cuts the lineage of iterative operators and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more, so that rounds hold a bounded number of them."""
    read = {f.rsplit("/", 2)[-2] for table in tables for f in table.inputFiles()}
    paths = [p for p in _written if p.rsplit("/", 1)[-1] in read]
    _written[:] = [p for p in _written if p not in paths]
    _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this process, once their results are written elsewhere."""
    paths, _written[:] = list(_written), []
    _delete(spark, paths)
    return len(paths)


#: Most bytes a table may have to be broadcast.
BROADCAST_BYTES = 64 << 20


def sized_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` as one side of a join: broadcast when its measured size allows, else merge join.

    Spark estimates a table that comes out of ``explode`` by the size of its input, which is far
    too low. So the size is measured, by one aggregate over the side that may be small, and
    beyond the limit the join is kept from broadcasting either side.
    """
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    small = (df.agg(size).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit)
    return F.broadcast(df) if small else df.hint("merge")
