"""Writing results. Every write goes to a new folder or appends; nothing is edited in place."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.operators.resolve import append_if_absent
from assetweave.session import local_path, task_count


def write_labeled(df: DataFrame, label: str, source: str, path: str, suffix: str = "_labeled") -> None:
    """Labelled items below `path`, one folder `<source>_labeled` per input, TYPE first."""
    rest = [c for c in df.columns if c not in (label, source)]
    (df.select(F.col(label).alias("TYPE"), *rest, F.concat(F.col(source), F.lit(suffix)).alias("source"))
     .write.mode("errorifexists").partitionBy("source").parquet(path))


def append_absent(df: DataFrame, path: str, key: str, order: str) -> None:
    """Append rows whose key the table at `path` does not hold yet."""
    existing = df.sparkSession.read.parquet(path)
    append_if_absent(existing, df, key, order).select(*existing.columns).write.mode("append").parquet(path)


def save_learning(candidates: DataFrame, path: str, settings: dict, now: str) -> None:
    """Candidate counters and settings as JSON; a row per keyword, as vocabularies are large."""
    candidates.select("category", "keyword", "weight").write.mode("errorifexists").json(f"{path}/candidates")
    candidates.sparkSession.range(1).select(
        F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("settings"),
        F.lit(now).alias("last_updated")).write.mode("errorifexists").json(f"{path}/settings")


def load_learning(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("category string, keyword string, weight double").json(f"{path}/candidates")


def load_settings(spark: SparkSession, path: str) -> dict:
    """The settings that were saved with the candidates, and when."""
    row = spark.read.json(f"{path}/settings").first()
    return {**row["settings"].asDict(), "last_updated": row["last_updated"]}


def replace_dictionary(old: DataFrame, new: DataFrame, path: str, snapshots: str, version: int, stamp: str) -> None:
    """The old dictionary is kept as a snapshot before the new one becomes the newest version."""
    snapshot(old, snapshots, stamp)
    write_version(new, path, version)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """A complete new version of a table; readers take the newest one that the table of finished versions lists."""
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")
    df.sparkSession.range(version, version + 1).toDF("version").write.mode("append").parquet(f"{path}/finished")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Newest version that was written to its end."""
    newest = spark.read.schema("version long").parquet(f"{path}/finished").agg(F.max("version")).first()[0]
    if newest is None:
        raise ValueError(f"no finished version below {path}")
    return spark.read.parquet(f"{path}/version={newest}")


def snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """Copy of a table taken before it changes, under its time stamp."""
    df.write.mode("errorifexists").parquet(f"{path}/snapshot_ts={stamp}")


def write_match_report(detail: DataFrame, summary: DataFrame, vendors: DataFrame, path: str) -> None:
    detail.write.mode("errorifexists").parquet(f"{path}/detail")
    vendors.write.mode("errorifexists").parquet(f"{path}/vendors")
    summary.write.mode("errorifexists").json(f"{path}/summary")


def _make_file_writer(path: str):
    # nested, so that it ships by value and workers need not import this package
    def write(batches):
        import hashlib
        import os
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = f"part-{task.partitionId():05d}", task.taskAttemptId()
        folders, seen, n = {}, Counter(), 0
        odd = {c: f"%{ord(c):02X}" for c in map(chr, range(1, 0x80)) if c < " " or c in "\"#%'*/:=?\\\x7f{[]^"}
        for batch in batches:
            keys, names, values = (batch.column(i).to_pylist() for i in range(3))
            for key, name, value in zip(keys, names, values, strict=True):
                if name not in folders:
                    folders[name] = f"{path}/folder={''.join(odd.get(c, c) for c in name) if name else '__HIVE_DEFAULT_PARTITION__'}"
                    os.makedirs(folders[name], exist_ok=True)
                line = f"{value or ''}\n".encode()
                row = repr((key, name)).encode("utf-8", "surrogatepass") + line
                digest = hashlib.blake2b(row, digest_size=16).hexdigest()
                # a task that runs again gives a row the same name, in whatever order rows come, and puts whole files in place
                file = f"{part}-{digest}-{seen[digest]}.txt"
                seen[digest] += 1
                with open(unfinished := f"{folders[name]}/.{file}.{attempt}", "wb") as f:
                    f.write(line)
                os.replace(unfinished, f"{folders[name]}/{file}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return write


def write_files(df: DataFrame, key: str, folder: str, value: str, path: str) -> None:
    """A text file per row, with `value` as its only line, in the folder `folder=<name>` below the new folder `path`.

    Texts in too few splits to keep all cores busy are dealt to all tasks by `key` and value. Spark's writer starts two processes for each file
    on a local disk, to set its rights and those of its checksum; so tasks write there themselves. Other file systems are left to it.
    """
    spark, target = df.sparkSession, local_path(df.sparkSession, path)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(folder).cast("string").alias("folder"), F.col(value).alias("value"))
    if rows.rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism:
        rows = rows.repartition(task_count(spark), "key", "value")
    if target is None:
        rows.select("value", "folder").write.mode("errorifexists").partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
        return
    os.makedirs(target)
    rows.mapInArrow(_make_file_writer(target), "n long").agg(F.sum("n")).collect()
