"""Size-tiered compaction of Parquet shards under a versioned manifest, all in DataFrame functions.

A table is a folder: ``data/`` holds immutable shards, ``manifests/<name>`` lists the shards of a version as a table,
and the small file ``manifests/v<number>`` names that list. An
append writes its rows as small shards and commits a version that lists them too. A compaction takes the tiers (shards
of similar size, by powers of ``fan_in``) that hold at least ``fan_in`` shards below half the target, merges them into
files of about the target size, and commits a version with the merged files in place of the small ones. So a row is
rewritten at most once a tier between its arrival's size and the target, however large the table grows. A version's
file is written aside and then takes its name in one step that fails if the name is taken: readers see all of a version
or none, and of two writers of one version exactly one succeeds; the other one tries again on top of it.
"""

from __future__ import annotations

import math
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "path string, bytes long, n_rows long, added long"


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def current_version(spark: SparkSession, table: str) -> int:
    """The newest committed version, 0 for none."""
    fs, folder = _fs(spark, f"{table}/manifests")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0)


def manifest(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The shards of a version: path, bytes, n_rows, and the version that added each."""
    version = current_version(spark, table) if version is None else version
    if not version:
        return spark.createDataFrame([], MANIFEST)
    name = spark.read.text(f"{table}/manifests/v{version}").first()[0]
    return spark.read.schema(MANIFEST).parquet(f"{table}/manifests/{name}")


def _take_name(fs, aside, target) -> bool:
    """Gives a file its final name; false if that is taken. A hard link on a local file system; elsewhere a rename,
    which for files fails where the target exists (as HDFS does in one step)."""
    if fs.getUri().getScheme() == "file":
        try:
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            fs.delete(aside, False)
        return True
    if not fs.exists(target) and fs.rename(aside, target):
        return True
    fs.delete(aside, False)
    return False


def commit(spark: SparkSession, table: str, shards: DataFrame, version: int) -> None:
    """Makes ``shards`` the given version; raises FileExistsError if another writer has made it."""
    name = f"list-{uuid.uuid4().hex}"
    shards.select("path", "bytes", "n_rows", "added").coalesce(1).write.parquet(f"{table}/manifests/{name}")
    fs, aside = _fs(spark, f"{table}/manifests/.{name}")
    out = fs.create(aside, False)
    out.write(bytearray(name.encode()))
    out.close()
    if not _take_name(fs, aside, _fs(spark, f"{table}/manifests/v{version}")[1]):
        fs.delete(_fs(spark, f"{table}/manifests/{name}")[1], True)
        raise FileExistsError(f"version {version} was committed by another writer")


def _shards(spark: SparkSession, folder: str, schema, version: int) -> DataFrame:
    """The files below a folder with their sizes and row counts."""
    files = spark.read.schema(schema).parquet(folder)
    return (
        files.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("added", F.lit(version).cast("long"))
    )


def append(rows: DataFrame, table: str, max_records: int = 100_000, tries: int = 20) -> int:
    """Writes the rows as small shards and commits them; returns the new version.

    The shards are written once; where another writer was first, they are committed on top of its version, so neither's
    rows are lost. Rows are kept as they are: nulls, repeated rows, empty and long texts. No rows make a version without
    new shards."""
    spark = rows.sparkSession
    folder = f"{table}/data/a-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").option("maxRecordsPerFile", max_records).parquet(folder)
    for _ in range(tries):
        version = current_version(spark, table) + 1
        new = _shards(spark, folder, rows.schema, version)
        try:
            commit(spark, table, manifest(spark, table, version - 1).unionByName(new), version)
        except FileExistsError:
            continue
        return version
    raise FileExistsError(f"{tries} versions in a row were committed by other writers")


def merge_plan(shards: DataFrame, target_bytes: int, fan_in: int) -> DataFrame:
    """The shards to merge, each with the name of the run (``_compaction_run``) that takes it.

    Shards of half the target or more are done. The others are tiered by size; tiers of at least ``fan_in`` shards are
    merged. Within a tier shards are cut, in order of path, where the running size passes multiples of the target; a
    merged file so holds at most the target and one shard more."""
    small = shards.where(2 * F.col("bytes") < target_bytes)
    tier = F.floor(F.log(F.greatest("bytes", F.lit(1)).cast("double")) / math.log(fan_in)).cast("int")
    tiered = small.withColumn("tier", tier)
    full = tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= fan_in)
    order = Window.partitionBy("tier").orderBy("path")
    running = F.sum("bytes").over(order) - F.col("bytes")
    return (
        tiered.join(F.broadcast(full), "tier")
        .withColumn("_part", F.floor(running / target_bytes))
        .withColumn("_compaction_run", F.concat_ws("-", F.col("tier"), F.col("_part")))
        .withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy("_compaction_run")))
        .where(F.col("_of") > 1)
        .select("path", "_compaction_run", "bytes")
    )


def compact(spark: SparkSession, table: str, schema, target_bytes: int = 256 << 20, fan_in: int = 4) -> int:
    """One round of merges; returns the new version, or the old one if no tier is full.

    Rows are kept as they are. Where another writer was first nothing is committed: the merged files are dropped and
    FileExistsError is raised, as the plan was made for an older version. A column may have any name but those of the
    two that this adds (``_compaction_run``, ``_compaction_path``)."""
    version = current_version(spark, table)
    shards = manifest(spark, table, version)
    plan = merge_plan(shards, target_bytes, fan_in)
    merges = [(r.path, r._compaction_run) for r in plan.select("path", "_compaction_run").collect()]  # names of files, not rows
    if not merges:
        return version
    if {"_compaction_run", "_compaction_path"} & set(schema.names):
        raise ValueError("the table has a column of a name that compaction uses")
    names = sorted({run for _, run in merges})
    number = {run: k for k, run in enumerate(names)}
    folder = f"{table}/data/c-{uuid.uuid4().hex}"
    source = spark.read.schema(schema).parquet(*[p for p, _ in merges]).withColumn("_compaction_path", F.col("_metadata.file_path"))
    runs = spark.createDataFrame([(p, number[r]) for p, r in merges], "_compaction_path string, _compaction_run int")
    runs = F.broadcast(runs) if len(merges) <= 200_000 else runs  # beyond that many names, an ordinary join
    merged = source.join(runs, "_compaction_path").drop("_compaction_path")
    # A run is one file of about the target, so one task; its number is its partition, so no task gets two.
    dealt = merged.repartitionById(len(names), F.col("_compaction_run"))
    dealt.write.option("compression", "zstd").partitionBy("_compaction_run").parquet(folder)
    new = _shards(spark, folder, schema, version + 1)
    kept = shards.join(spark.createDataFrame([(p,) for p, _ in merges], "path string"), "path", "left_anti")
    try:
        commit(spark, table, kept.unionByName(new), version + 1)
    except FileExistsError:
        fs, merged_files = _fs(spark, folder)
        fs.delete(merged_files, True)
        raise
    return version + 1


def compact_all(spark: SparkSession, table: str, schema, **settings) -> int:
    """Rounds of merges until no tier is full."""
    version = current_version(spark, table)
    while (new := compact(spark, table, schema, **settings)) != version:
        version = new
    return version


def expire(spark: SparkSession, table: str, grace_seconds: float = 86_400.0) -> int:
    """Deletes shards that the newest version doesn't list and that are older than the grace period; returns how many.

    The period must be longer than any append or compaction takes: shards are written before they are committed, and
    only their age tells such ones from those that were merged. Readers of older versions lose theirs."""
    listed = {r.path.rpartition("/data/")[2] for r in manifest(spark, table).select("path").collect()}
    fs, folder = _fs(spark, f"{table}/data")
    gone, files, limit = 0, fs.listFiles(folder, True), (time.time() - grace_seconds) * 1000
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString().rpartition("/data/")[2]
        if name.endswith(".parquet") and name not in listed and status.getModificationTime() <= limit:
            gone += bool(fs.delete(status.getPath(), False))
    return gone


def read(spark: SparkSession, table: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version, with ``shard_id`` (the file's name below data/). A column of that name is replaced."""
    paths = [r.path for r in manifest(spark, table, version).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("shard_id", F.lit(None).cast("string"))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/data/(.*)$", 1)
    return spark.read.schema(schema).parquet(*paths).withColumn("shard_id", name)
