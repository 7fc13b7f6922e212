"""Session, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested with, the package known to its workers."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vacantia")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, so that they find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="vacantia-")) / "vacantia.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as package:
        for source in sorted(here.rglob("*.py")):
            package.write(source, Path("vacantia") / source.relative_to(here))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the archive's parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or one of our own where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="vacantia-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def pieces(spark: SparkSession) -> int:
    """Partitions for a step whose work is far larger than its bytes: those alone would make few tasks of it."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores; without keys, as a repartition by the keys of the aggregation before it would be optimized away."""
    return df.repartition(pieces(df.sparkSession))


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of any executor, and keeps column pruning for the readers.
    Removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
