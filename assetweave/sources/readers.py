"""Reading items, dictionaries, libraries and logs."""

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetweave.functions import names
from assetweave.functions.text import strip
from assetweave.session import cut_lineage, local_path, task_count


def read_items(spark: SparkSession, path: str, fmt: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Items from Parquet or from CSV files whose header is on the second line.

    All columns are read as text. Files may have different headers, and any number of them: one scan finds each file's own, a
    second one reads all rows by position and takes every column from where the row's file has it. Columns that a file
    lacks are null, rows that repeat the header go. `columns` names what to read; without it, it is every name that occurs, which
    the driver then has to know, by place and name.
    """
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else
                  "parquet" if path.rstrip("/").lower().endswith(".parquet") else None)
    if fmt == "parquet":
        found = spark.read.parquet(path)
        return found.select(*columns) if columns else found
    if fmt != "csv":
        raise ValueError(f"unsupported item file format: {path}")
    heads = cut_lineage(_headers(spark, path), "headers")
    width = heads.agg(F.max(F.size("_names"))).first()[0]
    if not width:
        raise ValueError(f"no item file at {path}")
    if columns is None:
        named = heads.select(F.posexplode("_names").alias("at", "name")).filter("name <> ''")
        columns = [r[0] for r in named.groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    places = [f"_c{i}" for i in range(width)]
    rows = spark.read.csv(path, header=True, enforceSchema=True, mode="PERMISSIVE", escape='"', schema=", ".join(f"{c} string" for c in places))
    rows = rows.select(F.col("_metadata.file_path").alias("_path"), F.array(*places).alias("_values"))
    rows = rows.join(heads, F.col("_path") == F.col("_file"))
    said = F.transform(F.slice("_values", 1, F.size("_names")), lambda v: F.coalesce(v, F.lit("")))
    return rows.filter(said != F.col("_names")).select(*[
        F.get("_values", F.array_position("_names", F.lit(c)) - 1).alias(c) for c in columns])


CELL = r'("(?:[^"]|"")*"|[^",]*)(?:,|$)'


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _names): the cells of the second line of each text file, one row per file.

    Line numbers of a task rise by one, so the first two lines of a file are the smallest even and the smallest odd one.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("start"),
                                         F.monotonically_increasing_id().alias("at"), F.struct("value").alias("line"))
    first = lines.filter("start = 0").groupBy("_file", (F.col("at") % 2).alias("odd")).agg(F.min(F.struct("at", "line")).alias("l"))
    second = first.groupBy("_file").agg(F.max("l").alias("l"), F.count("*").alias("n")).filter("n = 2").select("_file", "l.line.value")
    # the last match is the empty one behind the line's end
    cells = F.regexp_extract_all(F.regexp_replace("value", "\r$", ""), F.lit(CELL), F.lit(1))
    cells = F.when(F.regexp_replace("value", "\r$", "").endswith(","), cells).otherwise(F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0))))
    bare = F.transform(cells, lambda c: F.when(c.startswith('"'), F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')).otherwise(c))
    return second.select("_file", bare.alias("_names"))


def list_inputs(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".parquet")) -> DataFrame:
    """(path, file_name, length, modificationTime) of the files worth processing."""
    files = spark.read.format("binaryFile").load(path).drop("content")  # bytes are never read
    return files.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1)) \
        .filter(names.is_input_name(F.col("file_name"), suffixes))


def parse_dictionary(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lower-case terms, without blank and comment lines."""
    bare = strip(F.col(column))
    return lines.withColumn("keyword", F.lower(bare)).filter((bare != "") & ~bare.startswith("#"))


def load_dictionary(spark: SparkSession, path: str, category: str) -> DataFrame:
    return parse_dictionary(spark.read.text(path)).select(F.lit(category).alias("category"), "keyword")


def _make_lister():
    # nested, so that it ships by value and workers need not import this package
    def lister(batches):
        """What lies directly in each folder, as Spark's readers see it: no hidden, unfinished or empty files."""
        import os

        import pyarrow as pa

        def entries(folder):
            with os.scandir(folder) as found:
                for x in found:
                    name, at = x.name, os.path.join(folder, x.name)
                    hidden = name.startswith(".") or name.startswith("_") and "=" not in name
                    try:
                        if x.is_dir():
                            if name.startswith(("_metadata", "_common_metadata")) or not (hidden or name.endswith("._COPYING_")):
                                yield at, None, None
                            continue
                        if hidden or name.endswith("._COPYING_"):
                            continue
                        status = x.stat()
                    except FileNotFoundError:  # gone meanwhile, or a link to nowhere
                        continue
                    if status.st_size:
                        yield os.fsencode(at).decode("utf-8", "replace"), status.st_size, status.st_mtime_ns // 1_000_000

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["path", "length", "ms"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for row in entries(folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return lister


def _local_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of the files below a local folder, one level of folders after the other.

    Tasks list, a folder each; neither files nor folders are held by the driver.
    """
    level, found = spark.createDataFrame([(folder,)], "path string"), None
    while True:
        listed = cut_lineage(level.repartition(task_count(spark)).mapInArrow(_make_lister(), "path string, length long, ms long"), "listing")
        files = listed.filter("length IS NOT NULL")
        found = files if found is None else found.unionByName(files)
        level = listed.filter("length IS NULL").select("path")
        if level.isEmpty():
            return found.select(F.concat(F.lit("file:"), "path").alias("path"), "length", F.timestamp_millis("ms").alias("modificationTime"))


def scan_library(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Document files below supplier folders, with size and time; contents are not read.

    Spark's own reader keeps every file in the driver and plans a task for some thirty of them. So the tasks list local folders themselves;
    other file systems and paths with wildcards are left to it.
    """
    folder = local_path(spark, path)
    if folder and os.path.isdir(folder) and not re.search(r"[{}\[\]*?\\]", path):
        name = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        files = _local_files(spark, folder).filter(F.regexp_extract("path", r"(?s)([^/]*)$", 1).rlike(f"(?s)^(?:{name})\\z"))
    else:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", pattern).load(path).drop("content"))
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("supplier"),
                        F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
                        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def latest_input(files: DataFrame, name: str, modified: str) -> DataFrame:
    """The newest labelled file, or the newest of all when none is labelled."""
    labelled = names.file_stem(F.col(name)).endswith("_labeled").cast("int")
    return files.agg(F.max_by(F.col(name), F.struct(labelled, F.col(modified), F.col(name))).alias("file_name"))


def run_facts(content: Column) -> list[Column]:
    """Time, input file, seconds and status out of the text of one run log."""
    def first(pattern: str) -> Column:
        value = F.regexp_extract(content, pattern, 1)
        return F.when(value == "", F.lit(None)).otherwise(value)
    ok = F.contains(content, F.lit("PIPELINE COMPLETE")) & ~F.contains(content, F.lit("FAILED"))
    return [
        F.coalesce(first(r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"), F.lit("-")).alias("time"),
        F.coalesce(strip(first(r"(?m)Input file:\s*(.+?)$")), F.lit("-")).alias("file"),
        first(r"(?i)finished in ([\d.]+) s").try_cast("double").alias("seconds"),
        F.when(ok, "success").otherwise("failed").alias("status")]


def parse_run_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per run log file below `path`."""
    logs = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("run"), "value")
    return logs.select("run", *run_facts(F.col("value")))
