"""Session defaults and the shared working folder."""

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "assetweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs expect; a cluster's own defaults win elsewhere."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session that has none gets one, which goes when the process ends."""
    base, master, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master, spark.sparkContext.applicationId
    if base:
        return base.rstrip("/")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="run-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that every executor can reach. All folders of an application lie below its id, for removal with it."""
    return f"{_base(spark)}/assetweave/{spark.sparkContext.applicationId}/{label}-{uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there.

    A lost executor then costs a re-read and not a re-run, and the planner knows the real
    size of the table when it chooses joins.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system knows it, None where another file system holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def task_count(spark: SparkSession) -> int:
    """Tasks for small but expensive inputs, which size-based coalescing would starve."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
